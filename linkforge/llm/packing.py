"""Best-fit packing by minimum bin slack.

Tokens stay on the executors. Only the number of pieces of each length, at most `capacity` rows
whatever the corpus, goes to the driver. There each bin starts with the longest piece left and a
bitset dynamic programme over the lengths left finds the fullest feasible completion; the bin is
repeated as often as the counts allow, then its pieces are removed. Pieces find their places by
their rank among pieces of equal length.

Null text is empty and gives one piece that holds the end token alone. Rows with equal doc_id are
packed separately. An empty table gives no rows. Other columns, clashing names included, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, lean

CAPACITY = 4096
END_ID = 1
#: Words in each of the two generations that a worker remembers; the older is dropped when the younger is full.
REMEMBERED = 400_000
#: Characters of which the words are looked up at once.
PORTION = 1 << 20
#: Parts into which the pieces of one length are dealt for ranking.
SALTS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


#: Beyond these letters case and composition can depend on neighbours: such texts are not lowered here.
_OTHER = re.compile("[^\x00-\u017f]|<\\|")
#: Letters with punctuation after them: the tokenizer cuts between the two.
_WORD = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


def _whole(text: str) -> bool:
    try:
        text.encode("latin-1")  # quicker than the search, where it can be had
    except UnicodeEncodeError:
        return _OTHER.search(text) is not None
    return "<|" in text


class WordTokens:
    """Token bytes (little-endian unsigned 32-bit ids) of whole texts by a white-space-dropping, lower-casing tokenizer.

    The tokenizer never joins across a blank or line feed, so ids of the parts between them, each
    looked up once, make up the ids of the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = max(self.tokenizer.get_vocab().values())
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(last + 1)])
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Of parts that the tokenizer does not cut: all at once, told apart by their last tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.uint32)
        at = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(at) != len(runs):
            return self.encode(runs)
        raw, at = ids.tobytes(), at.tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def renew(self, new: set[str]) -> set[str]:
        """Bring those that the old generation has into the young one; the others."""
        back = self.old.keys() & new
        self.young.update(zip(back, map(self.old.__getitem__, back)))
        return new - back

    def learn(self, new: set[str], whole: bool) -> None:
        """Put `new` words into the young generation."""
        young, runs, cut, other = self.young, set(), [], []
        for w in self.renew(new):
            m = None if whole else _WORD.fullmatch(w)
            if not m:
                other.append(w)
            elif m[2]:
                cut.append((w, m[1], m[2]))
                runs.update(m.groups())
            else:
                runs.add(w)
        if other:
            young.update(zip(other, self.encode(other)))
        if runs := list(self.renew(runs.difference(young))):
            young.update(zip(runs, self.encode_runs(runs)))
        for w, core, rest in cut:
            young[w] = young[core] + young[rest]

    def many(self, texts: list[str]) -> list[bytes]:
        """Those of several texts, whose new words are learnt together: each text is gone through once to find them and once to put them in."""
        kinds = [_whole(t) for t in texts]
        split = [(t if whole else t.lower()).replace("\n", " ").split(" ") for t, whole in zip(texts, kinds)]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {"": b""}
        for kind in {*kinds}:
            met = set().union(*(parts for parts, whole in zip(split, kinds) if whole == kind))
            if new := met.difference(self.young):
                self.learn(new, kind)
        find = self.young.__getitem__
        return [b"".join(map(find, parts)) for parts in split]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in order, some `PORTION` characters at a time; null is empty."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own, kept for its next tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, tie of every piece; only longer documents are cut."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end, step = word_tokens(tokenizer_path), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            found = chain.from_iterable(map(ids_of.many, portions(t.as_py() for t in batch.column(1))))
            for d, ids in zip(batch.column(0).to_pylist(), found):
                ids += end
                tie = zlib.crc32(ids)
                if len(ids) <= step:
                    out.append((d, 0, 0, len(ids) // 4, tie, tie))
                    continue
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((d, k, k * capacity, len(part) // 4, zlib.crc32(part), tie))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tie"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, repeats counted, of the fullest combination that fits into `room`.

    Bit s of the set says that s is the sum of some combination; longer lengths are tried first
    and the programme ends as soon as the room can be filled whole.
    """
    reach, mask, target = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
            if reach & target:
                left = 0
        if reach & target:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) of bins that hold exactly the pieces counted."""
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        if not rest[longest]:
            del rest[longest]
        combination = [longest, *fullest(rest, capacity - longest)]
        used = {x: combination.count(x) for x in set(combination)}
        repeats = min(counts[x] // n for x, n in used.items())
        bins.append((repeats, combination))
        for x, n in used.items():
            counts[x] -= n * repeats
            if not counts[x]:
                del counts[x]
    return bins


def places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of a length go, by rank."""
    out, seen, sequence = [], {}, 0
    for repeats, lengths in bins:
        at = 0
        for x in lengths:
            out.append((x, seen.get(x, 0), repeats, sequence, at))
            seen[x] = seen.get(x, 0) + repeats
            at += x
        sequence += repeats
    return out


def ranked(df: DataFrame, key: str, order: list[Column], salt: Column) -> DataFrame:
    """`df` with `rank`, from 0 within `key`, without ever gathering a key in one task."""
    df = df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    sizes = df.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = df.withColumn("_own", F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order)))
    return own.join(base, [key, "_salt"]).withColumn("rank", F.col("_base") + F.col("_own") - 1).drop("_salt", "_base", "_own")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, length and more columns) with sequence_id and offset."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = places(minimum_bin_slack(counts, capacity))
    where = spark.createDataFrame(rows, "length long, lo long, n long, sequence long, offset long")
    order = [F.col(c) for c in ("doc_id", "piece", "tie", "ids_crc32")]
    at = ranked(found, "length", order, F.xxhash64("doc_id", "piece", "tie"))
    hit = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n"))
    # each length has few ranges and at most `capacity` ** 2 exist: a table bounded by the capacity
    return (
        at.join(F.broadcast(where), (at["length"] == where["length"]) & hit)
        .drop(where["length"])
        .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("lo"))
        .drop("rank", "lo", "n", "sequence", "tie")
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    found = cut(pieces(docs, tokenizer_path, capacity, doc_id, text))
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
