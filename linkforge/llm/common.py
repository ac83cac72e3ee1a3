"""Shared pieces of the training-data operators: durable cuts, byte kernels, components.

Lineage is cut only in the shared folder, so a lost executor costs a recomputation and never a result.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bucketed as bucketed
from ..shared import cut, delete, written

#: Bytes of text that a NumPy kernel works on at once; temporaries take about 60 times that.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1


_made: list[str] = []


def table(df: DataFrame) -> DataFrame:
    """Compute `df` now and keep it as Parquet in the shared folder, for wide or large rows; the files go with the driver, if not before."""
    path = written(df)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    return len(_made)


def drop_tables(spark: SparkSession, mark: int) -> None:
    """Delete the tables made since `tables_made()` gave `mark`, but for the newest; nothing else may read them any more."""
    for path in _made[mark:-1]:
        delete(spark, path)
    del _made[mark:-1]


def release(spark: SparkSession) -> None:
    """Let the driver drop what is no longer referenced, so that executors delete its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps what arrays of some MB leave
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run` on a task's batches or one group; what its arrays leave free goes back to the system, as Spark keeps the worker for other stages."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def whole(batches):
            try:
                yield from run(batches)
            finally:
                _give_back()

    else:

        @functools.wraps(run)
        def whole(group):
            try:
                return run(group)
            finally:
                _give_back()

    return whole


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: fewer rows at a time go to the Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like `names` that `df` does not have, whatever its own are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, n_bytes: int, each: int = 8 << 20, most: int = 20) -> int:
    """A power of two of hash buckets, 2 ** `most` at most, so that one holds what about `each` bytes of text give."""
    return 1 << min(most, max(8, (n_bytes // each).bit_length(), (width(spark) - 1).bit_length()))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that name a text; equal texts share it."""
    return F.unhex(F.md5(text.cast("binary")))


# --------------------------------------------------------------------------- byte kernels


def text_chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of about `size` bytes and at most `rows` rows; null is empty.

    A single longer text is one slice of its own, never cut.
    """
    col = batch.column(column)
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    n = len(col)
    if not n:
        return
    _, off_buf, data = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi, raw[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo])
        lo = hi


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` takes the hash of any span."""
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    one = total[1:]
    np.take(_BYTE, buf, out=one, mode="clip")
    one *= powers(_P, len(buf))
    np.cumsum(one, out=one)
    return total


def window_hashes(total: np.ndarray, w: int) -> np.ndarray:
    """`span_hash` of every window of `w` bytes, with fewer temporaries."""
    h = total[w:] - total[: len(total) - w]
    h *= powers(_PINV, len(total))[: len(h)]
    h += U64(w * 0xD6E8FEB86659FD93 & _MASK)
    for lo in range(0, len(h), PIECE):
        h[lo : lo + PIECE] = mix(h[lo : lo + PIECE])
    return h


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same wherever equal bytes stand."""
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * powers(_PINV, len(total))[start] + size * U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place where it can be."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = _random(256, 11)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base & _MASK, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = out
        if size <= 2 * CHUNK_BYTES:  # those of one very long text go with it
            _powers[base] = out
    return have[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: A random number for each byte at each of 256 places in a word; bytes that are no part of words count nothing.
_PLACED = _random(256 * 256, 11).reshape(256, 256)[:, _LOWER]
_PLACED[:, ~_WORD] = 0
_PLACED = np.ascontiguousarray(_PLACED).reshape(-1)
#: Bytes of which words are hashed at once.
PIECE = 1 << 20


def _placed(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What bytes at these places of their words add to the words' hashes."""
    out = _PLACED[((place & 255) << 8) | x]
    far = np.flatnonzero((place > 255) & (out != 0))  # rare: later bytes of very long words are mixed with their place
    out[far] = mix(out[far] + (place[far] >> 8).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lowered, and each text's first word's index.

    A hash is a sum of random numbers drawn for each byte and place, so no pair of words is bound to collide.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = _WORD[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = off[:-1][off[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        s, e = start[i:j], int(end[j - 1])
        if e - s[0] > PIECE:  # one word longer than a piece
            h[i] = 0
            for lo in range(int(s[0]), e, PIECE):
                hi = min(e, lo + PIECE)
                h[i] += _placed(buf[lo:hi], np.arange(lo, hi) - s[0]).sum()
        else:
            place = np.arange(s[0], e) - np.repeat(s, np.diff(np.append(s, e)))
            h[i:j] = np.add.reduceat(_placed(buf[s[0] : e], place), s - s[0])
        i = j
    return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(start, off)


_C = _random(8, 23)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; under k words the whole sequence is one."""
    h, first = words(buf, off)
    whole = np.zeros(0, np.uint64)
    if len(h) >= k:
        whole = h[: len(h) - k + 1] * _C[0]
        for j in range(1, k):
            whole += h[j : len(h) - k + 1 + j] * _C[j]
        whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(whole[a : b - k + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif b > a:
            one = U64(0)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    one = one + h[a + j] * _C[j]
                x = mix(np.array([one + U64(b - a) * U64(0xA0761D6478BD642F)], np.uint64))
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


# ----------------------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of `edges`; component is the smallest id that it reaches.

    Alternates the large-star and small-star steps, each one shuffle with a partial minimum, until
    the edge set stands still, however many rounds that takes. A hub's neighbours stay rows; no list of them is ever gathered.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    old = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = cut(
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old is not None and tuple(now) == old:
            break
        old = tuple(now)
    low = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cut(low.unionByName(roots).groupBy("id").agg(F.min("component").alias("component")))
