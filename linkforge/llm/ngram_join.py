"""Similarity join on word n-grams: rare-first prefix filtering, exact at the threshold.

A text's set holds its distinct shingles of `K` words, or its whole word sequence if it has fewer.
Two texts link when their sets' Jaccard similarity is `PERCENT` per cent or more.

1. Equal texts are one class from the start. Sets are made in blocks of a few MB; (shingle, text) pairs go
   out by shingle hash in binary blocks, where each shingle's frequency in the whole corpus is counted. Those
   that occur once can't link anything and end there, though they keep their places in the order.
2. Back with its block, each set is put in order, rarest first. Linked sets share a shingle among the
   first n - ceil(tn) + 1; sets without a repeated shingle there are done.
3. Prefix shingles meet by an equi-join. A bucket of m texts first gives m - 1 pairs, each with the bucket's
   first text, under the length filter, the positional filter (what can still follow both places)
   and the suffix filter (the least difference of the sets by parts of the hash space). Each pair is
   verified once. Only buckets that still hold several components then give pairs across
   components, so a group of thousands of copies gives a number of pairs in proportion to its size
   while no link between components is lost.
4. Components come from star contractions over the links.

Shingles are compared by 64-bit hashes, each a sum of random numbers drawn for the bytes and places of its words, and by
nothing else: of two different shingles in 2 ** 64 one pair is expected to be taken for equal.

Null text, or one without words, has an empty set, links with nothing and is its own component. doc_id
is a key; rows that share a doc_id share its links, and rows without a doc_id have no component of their own: their
component_id is that of an equal text, else null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, buckets_for, components, fresh, lean, shingle_sets, small_batches, table, text_chunks, text_key

K, PERCENT = 5, 75
#: Parts of the hash space by which the suffix filter compares two sets.
PARTS = 16

BLOCK = "kind int, bucket int, block long, data binary"
_BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
NODE = "tk binary, n int, first int, keys array<long>, parts array<int>"
_NODE = pa.schema([("tk", pa.binary()), ("n", pa.int32()), ("first", pa.int32()), ("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])

PAIRS, TEXTS = 0, 1


def _pairs(data: pa.Buffer, bucket: int, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Whole 64-bit hashes and texts of a blob of pairs, and their number: the bucket is the hash's first bits, seven bytes are the rest."""
    n = data.size // width
    h = np.frombuffer(data, np.uint32, n).astype(np.uint64)
    h |= np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << U64(32)
    h |= np.frombuffer(data, np.uint8, n, 6 * n).astype(np.uint64) << U64(48)
    h &= U64((1 << 65 - buckets.bit_length()) - 1)
    return h | U64(bucket << 65 - buckets.bit_length()), np.frombuffer(data, np.uint16, n, 7 * n), n


def _blob(h: np.ndarray, text: np.ndarray) -> bytes:
    return h.astype(np.uint32).tobytes() + (h >> U64(32)).astype(np.uint16).tobytes() + (h >> U64(48)).astype(np.uint8).tobytes() + text.tobytes()


def _blocks(buckets: int, k: int):
    """For each block of texts its (shingle, text) pairs by bucket, and the texts' keys and set sizes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column("tk").to_pylist()
            for lo, hi, buf, off in text_chunks(batch, "text"):
                sets, names = [], []
                for tk, s in zip(keys[lo:hi], shingle_sets(buf, off, k)):
                    if tk is not None and tk not in seen and len(s):  # of equal texts one goes on from here
                        seen.add(tk)
                        sets.append(s)
                        names.append(tk)
                if not sets:
                    continue
                n = np.array([len(s) for s in sets], np.int32)
                h, text = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
                # from all names: only blocks of the same texts share an id
                block = int.from_bytes(hashlib.blake2b(b"".join(names), digest_size=8).digest(), "little", signed=True)
                bucket = (h >> U64(65 - buckets.bit_length())).astype(np.int64)
                order = np.argsort(bucket.astype(np.int32), kind="stable")
                h, text, bucket = h[order], text[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = [(TEXTS, block % buckets, block, b"".join(names) + n.tobytes())]
                for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
                    rows.append((PAIRS, int(bucket[a]), block, _blob(h[a:e], text[a:e])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)

    return run


def _frequencies(buckets: int):
    @lean
    def run(group: pa.Table) -> pa.Table:
        """Keep the pairs whose shingle occurs again, with its frequency in steps of an eighth of a doubling."""
        kind = group.column("kind").to_numpy()
        out = [group.filter(pa.array(kind == TEXTS))] if (kind == TEXTS).any() else []
        part = group.filter(pa.array(kind == PAIRS))
        if part.num_rows:
            bucket = part.column("bucket")[0].as_py()
            keys, texts, size = zip(*(_pairs(x.as_buffer(), bucket, buckets, 9) for x in part.column("data")))
            key, text = np.concatenate(keys), np.concatenate(texts)
            del keys, texts
            order = np.argsort(key)
            sorted_ = key[order]
            new = np.ones(len(key), bool)
            np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
            del sorted_
            run_of = np.cumsum(new, dtype=np.int32) - 1
            times = np.empty(len(key), np.int32)
            times[order] = np.bincount(run_of)[run_of]
            del order, new, run_of
            keep = times > 1
            level = np.minimum(255, 8 * np.log2(times[keep])).astype(np.uint8)
            row = np.repeat(np.arange(len(size), dtype=np.int32), size)[keep]
            ends = np.searchsorted(row, np.arange(len(size) + 1))
            key, text = key[keep], text[keep]
            data = [_blob(key[a:b], text[a:b]) + level[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            out.append(pa.Table.from_arrays([part.column("kind"), part.column("bucket"), part.column("block"), pa.array(data, pa.binary())], schema=_BLOCK).filter(pa.array(np.diff(ends) > 0)))
        return pa.concat_tables([t.cast(_BLOCK) for t in out])

    return run


def _orders(percent: int, buckets: int):
    @lean
    def run(group: pa.Table) -> pa.Table:
        """Each text's repeated shingles, rarest first, and their number by parts; null where its prefix holds none."""
        kind, bucket = group.column("kind").to_numpy(), group.column("bucket").to_numpy()
        data = group.column("data")
        head, *same = (data[int(i)].as_py() for i in np.flatnonzero(kind == TEXTS))
        if any(x != head for x in same):
            raise ValueError("blocks of different texts share an id")
        count = len(head) // 20
        names = [head[16 * i : 16 * i + 16] for i in range(count)]
        n = np.frombuffer(head, np.int32, count, 16 * count)
        keys, texts, levels = [], [], []
        for i in np.flatnonzero(kind == PAIRS):
            b = data[int(i)].as_buffer()
            key, text, m = _pairs(b, int(bucket[i]), buckets, 10)
            keys.append(key)
            texts.append(text)
            levels.append(np.frombuffer(b, np.uint8, m, 9 * m))
        first = n.copy()
        lists: list = [None] * count
        parts: list = [None] * count
        if keys:
            key, text, level = map(np.concatenate, (keys, texts, levels))
            order = np.lexsort((key, level, text))
            key, text = key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            key, text = key[new], text[new]
            ends = np.searchsorted(text, np.arange(count + 1))
            first = (n - np.diff(ends)).astype(np.int32)
            prefix = n - (percent * n.astype(np.int64) + 99) // 100 + 1
            for i in np.flatnonzero(first < prefix).tolist():
                own = key[ends[i] : ends[i + 1]]
                lists[i] = own.view(np.int64)
                parts[i] = np.bincount(((own >> U64(32)) & U64(PARTS - 1)).astype(np.int64), minlength=PARTS)
        return pa.Table.from_arrays([pa.array(names, pa.binary()), pa.array(n), pa.array(first, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))], schema=_NODE)

    return run


def _least(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of n and m shingles link."""
    return F.ceil((n + m) * percent / (100 + percent))


def _near(a: str, b: str, percent: int) -> Column:
    """Length and positional filters for rows of one bucket: set sizes na, nb and places pa, pb."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    fits = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    return fits & (F.least(na - pa_, nb - pb) >= _least(na, nb, percent))


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), given once each, whose sets link."""
    slim = nodes.select("id", "n", "first", "parts")
    sides = pairs.join(slim.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("ha")), "a").join(
        slim.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("hb")), "b"
    )
    most = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    sides = sides.where(most >= _least(F.col("na"), F.col("nb"), percent)).drop("ha", "hb")
    sets = nodes.select("id", "keys")
    full = sides.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("ka")), "a").join(sets.select(F.col("id").alias("b"), F.col("keys").alias("kb")), "b")
    both = full.select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def text_sets(slim: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """id, n, first, keys, parts of every class of equal texts; keys and parts are null where nothing can link.

    `slim` has doc_id, tk and text. first is the place of keys[0] in the rare-first order.
    """
    spark = slim.sparkSession
    small_batches(spark)
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(spark, n_bytes)
    blocks = slim.select("tk", "text").mapInArrow(_blocks(buckets, k), BLOCK)
    counted = blocks.repartition("bucket").groupBy("bucket").applyInArrow(_frequencies(buckets), BLOCK)
    ordered = counted.groupBy("block").applyInArrow(_orders(percent, buckets), NODE)
    names = slim.groupBy("tk").agg(F.min("doc_id").alias("id"))
    return table(ordered.join(names, "tk").dropDuplicates(["tk"]).select("id", "tk", "n", "first", "keys", "parts"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: enough of the links to join every component; each is verified."""
    nodes = sets.where("keys is not null and id is not null")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("first")
    rows = nodes.select("id", "n", "first", F.posexplode(F.slice("keys", 1, prefix.cast("int"))).alias("i", "key")).select("key", "id", "n", (F.col("first") + F.col("i")).alias("pos"))
    center = rows.groupBy("key").agg(F.min(F.struct("id", "n", "pos")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "c.*")
    met = rows.alias("x").join(center.alias("c"), "key").where("x.id <> c.id")
    stars = table(met.where(_near("x", "c", percent)).select(F.col("c.id").alias("a"), F.col("x.id").alias("b")).distinct())
    found = table(verified(stars, nodes, percent))
    group = components(found)
    labelled = rows.join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = labelled.join(mixed, "key")
    # only buckets that still hold several components, only across components, and each pair once
    cross = open_.alias("x").join(open_.alias("y"), "key").where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _near("x", "y", percent))
    more = cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    return table(found.unionByName(verified(more, nodes, percent)))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("tk"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = text_sets(slim, percent, k)
    group = components(links(sets, percent))
    known = sets.select("tk", "id", "n").join(group, "id", "left").select("tk", "n", F.coalesce("component", "id").alias("component"))
    return slim.select("doc_id", "tk").join(known, "tk", "left").select(
        "doc_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest doc_id of each component, columns unchanged.

    Of rows that repeat a doc_id the one with the smallest text hash stays. Documents without words are linked with
    nothing and all stay, as do rows without a doc_id, which can't name a component.
    """
    group = jaccard_components(docs, percent, k, doc_id, text)
    keep = group.where("doc_id = component_id or (n_shingles = 0 and doc_id is not null)").select("doc_id").distinct()
    own, key = fresh(docs, "_d", "_k")
    kept = docs.withColumn(own, F.col(f"`{doc_id}`").cast("long")).join(keep.withColumnRenamed("doc_id", own), own, "left_semi")
    # only a doc_id that repeats needs a choice, and its rows alone are ranked
    twice = kept.groupBy(own).count().where("count > 1").select(own)
    if twice.isEmpty():
        single = kept.drop(own)
    else:
        first = W.partitionBy(own).orderBy(text_key(F.col(f"`{text}`")))
        chosen = kept.join(twice, own, "left_semi").withColumn(key, F.row_number().over(first)).where(F.col(key) == 1).drop(key)
        single = kept.join(twice, own, "left_anti").unionByName(chosen).drop(own)
    return single.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
