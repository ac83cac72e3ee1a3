"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target over size. The whole
part is taken; the fractions are rounded in pairs: mass (in words) moves at random between two
documents until one of them is integral, which keeps every document's expectation and the words
of the pair exactly. Leaves of a few thousand documents do so at once, each hands one unfinished
document up, and a tree of fixed arity finishes these level by level, so a source of any size is
rounded by many tasks and ends within one document of its target. Draws depend on the seed, the
source and the place in the tree alone, so reruns agree.

Null text has size 0; documents of size 0 get the copies but no words. A null source is a source of
its own, ordered last. Rows with equal doc_id count one by one. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Documents that one leaf rounds, about, and unfinished ones that one inner node takes.
LEAF, ARITY = 4096, 64
SEED = 20_240_501


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target from (source, source_size, n).

    With a common level x a source gets min(cap * size, weight * x). Sources in order of cap * size
    over weight stop one after the other, so x follows from running sums over that order.
    """
    place = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    d = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # equal ratios and all rows ordered by name too: running sums are the same in every run
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    all_rows = W.partitionBy()
    d = (
        d.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("held", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("held")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("most"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(all_rows)["level"]
    return d.withColumn("x", level).select(
        "source", "source_size", "n", F.when(F.col("x").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("x"))).alias("target")
    )


def rounder(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds the fractions of one node; the one left open keeps copies null, unless this is the root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "size", "path"], kind="stable", na_position="last").reset_index(drop=True)
        first = rows.iloc[0]
        name = "\x00" if first["source"] is None else "\x01" + first["source"]
        draw = np.random.Generator(np.random.PCG64([seed, int(first["level"]), int(first["node"]), zlib.crc32(name.encode())])).random(len(rows)).tolist()
        # size-0 documents move no words: they are rounded by themselves
        p, s, whole = rows["p"].tolist(), rows["size"].tolist(), rows["whole"].tolist()
        done: list[float | None] = [None] * len(p)
        held = -1
        for i in range(len(p)):
            if p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
                done[i] = whole[i] + round(p[i])
                continue
            if s[i] == 0:
                done[i] = whole[i] + (draw[i] < p[i])
                continue
            if held < 0:
                held = i
                continue
            j, a, b = held, p[held] * s[held], p[i] * s[i]
            up = min(s[j] - a, b)  # words that can move to the one held
            down = min(a, s[i] - b)  # and from it
            move = up if draw[i] * (up + down) < down else -down
            a, b = (a + move) / s[j], (b - move) / s[i]
            open_ = []
            for k, q in ((j, a), (i, b)):
                p[k] = q
                if q <= 1e-9 or q >= 1 - 1e-9:
                    done[k] = whole[k] + round(q)
                else:
                    open_.append(k)
            held = open_[0] if open_ else -1
        if held >= 0 and last:
            done[held] = whole[held] + (draw[held] < p[held])
        rows["p"] = p
        rows["copies"] = pd.array(done, "Int64")
        return rows[["source", "doc_id", "size", "row_key", "h", "path", "level", "node", "whole", "p", "copies"]]

    return run


NODE = "source string, doc_id long, size long, row_key long, h long, path string, level int, node long, whole long, p double, copies long"


def pivotal(slim: DataFrame, seed: int = SEED, leaf: int = LEAF, arity: int = ARITY) -> DataFrame:
    """source, doc_id, size, row_key, copies from rows that carry rate (expected copies) and n (rows of their source)."""
    rows = (
        slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("nodes", F.greatest(F.lit(1), F.ceil(F.col("n") / leaf)))
        .withColumn("node", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "row_key"), F.col("nodes")))
        .withColumn("whole", F.floor("rate"))
        .select("source", "doc_id", "size", "row_key", "h", F.lit("").alias("path"), F.lit(0).alias("level"), "node", "whole", (F.col("rate") - F.col("whole")).alias("p"), F.lit(None).cast("long").alias("copies"))
    )
    nodes = slim.agg(F.max(F.ceil(F.col("n") / leaf))).first()[0] or 1
    level, out = 0, None
    while True:
        last = nodes <= 1
        rows = cut(rows.groupBy("source", "node").applyInPandas(rounder(seed, last), NODE))
        done = rows.where("copies is not null")
        out = done if out is None else out.unionByName(done)
        if last:
            return out.select("source", "doc_id", "size", "row_key", "copies")
        level, nodes = level + 1, -(-nodes // arity)
        rows = rows.where("copies is null").withColumns(
            {"path": F.concat_ws(".", F.col("node").cast("string"), F.col("path")), "level": F.lit(level), "node": F.floor(F.col("node") / arity)}
        )


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, row_key, source_size, target, copies of every row; copies times size are the words taken."""
    slim = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), row_key(docs).alias("row_key")))
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = cut(targets(sums, weights, share, cap))
    # a row for each source, joined on a null-safe key: never larger than the set of sources
    rated = slim.join(goal, slim["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rated = rated.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    copies = pivotal(rated.select("source", "doc_id", "size", "row_key", "rate", "n"), seed)
    back = goal.select("source", "source_size", "target")
    return copies.join(back, copies["source"].eqNullSafe(back["source"])).drop(back["source"])


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])


def mixed_documents(docs: DataFrame, **more) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    chosen = mix_sources(docs, **more)
    d, k, t, n, each = fresh(docs, "_d", "_k", "_t", "_copies", "_each")
    twin = lambda x, *by: x.withColumn(t, F.row_number().over(W.partitionBy(d, k).orderBy(*by)))
    left = twin(docs.withColumns({d: F.coalesce(F.col(f"`{more.get('doc_id', 'doc_id')}`").cast("long"), F.lit(-(1 << 63))), k: row_key(docs)}), F.lit(0))
    right = twin(chosen.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(d), F.col("row_key").alias(k), F.col("copies").alias(n)), F.desc(n))
    # identical rows are interchangeable: the i-th of them takes the i-th number of copies
    joined = left.join(right.where(F.col(n) > 0), [d, k, t])
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[f"`{c}`" for c in docs.columns])
