"""An exact index over vectors: cells with a centre and a radius, of which a query reads those that can hold one of its nearest.

For every member x of a cell with centre c and radius r the inner product q.x is at most q.c + |q| r. A query first reads its
best cells, as many as hold `k` members; the k-th product found is what a cell's bound has to reach to be read as well. So the result is
that of a full scan, whatever the centres are. Centres are a sample of at most `CELLS` vectors, every vector is in the cell of its nearest one.

A cell of many members is stored in blocks of about `BLOCK`. Cells stand on shelves of about `SHELF` members, so a query travels once for each shelf on which it
reads cells. Queries meet a shelf, or a block of a cell that has a shelf for itself, in parts; each meeting is worked off in tiles.
Candidates that a rounding might have moved are kept, and all products are summed again in order, as the scan sums them.
Vectors of one length are asked for. Rows without a vector are in no cell; a query without one finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..shared import table
from .blocks import in_order, matrix, tiles

CELLS, BLOCK, SHELF = 1024, 4096, 16384
#: Rows of a batch of visits, and the share of read cells on a shelf from which all are multiplied at once.
VISITS, DENSE = 1 << 16, 0.25
#: What rounding may move a product or a radius by, for each unit of the vectors' lengths.
SLACK = 1e-9


@dataclass
class Index:
    members: DataFrame  # cell, block, id, vector
    cells: DataFrame  # cell, centre, radius, n, blocks: at most CELLS rows

    def write(self, path: str) -> None:
        self.members.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")


def read(spark: SparkSession, path: str) -> Index | None:
    """The index at `path`; None where there is none, as a query then falls back."""
    try:
        return Index(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def build(vectors: DataFrame, cells: int = CELLS, block: int = BLOCK, id: str = "vec_id", vector: str = "embedding") -> Index:
    """The index of (id, vector)."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where("vector is not null")
    wanted = min(cells, CELLS, max(1, int(rows.count() ** 0.5)))
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(wanted).select("vector").collect()  # at most CELLS vectors
    centres = np.array([r["vector"] for r in sample], np.float64) if sample else np.zeros((0, 0))
    lengths = (centres**2).sum(1)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            if not len(x):
                continue
            cell = (lengths - 2 * x @ centres.T).argmin(1)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "vector", "cell", "away"])

    placed = table(rows.mapInArrow(assign, "id long, vector array<float>, cell int, away double"))
    found = placed.groupBy("cell").agg((F.max("away") * (1 + SLACK) + SLACK).alias("radius"), F.count(F.lit(1)).alias("n"))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])
    named = vectors.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], schema)
    cells_ = named.join(found, "cell").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sized = placed.join(F.broadcast(cells_.select("cell", "blocks")), "cell")  # at most CELLS rows
    return Index(sized.select("cell", F.pmod(F.xxhash64("id", "vector"), "blocks").cast("int").alias("block"), "id", "vector"), table(cells_))


def _shelves(index: Index) -> list[tuple[int, int, int]]:
    """cell, shelf, blocks; only a cell that has a shelf for itself may have several blocks."""
    out, shelf, filled = [], -1, SHELF
    for r in sorted(index.cells.select("cell", "n", "blocks").collect(), key=lambda r: r["cell"]):  # at most CELLS
        if r["blocks"] > 1 or filled + r["n"] > SHELF:
            shelf, filled = shelf + 1, 0
        filled = SHELF if r["blocks"] > 1 else filled + r["n"]
        out.append((r["cell"], shelf, r["blocks"]))
    return out


def _visits(queries: DataFrame, index: Index, k: int, first: bool) -> DataFrame:
    """query, q, part, shelf, cells: the cells that each query reads on a shelf; with `last`, those beyond the first ones that may still reach it."""
    rows = sorted(index.cells.collect(), key=lambda r: r["cell"])  # at most CELLS
    cell = np.array([r["cell"] for r in rows], np.int32)
    centre, radius, n = np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])
    shelf = np.array([s for _, s, _ in _shelves(index)], np.int32)

    def run(batches):
        step = max(1, VISITS // max(1, len(cell)))
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            q = matrix(batch.column("q"))
            if not len(q) or not len(cell):
                continue
            length = np.sqrt((q**2).sum(1))[:, None]
            bound = q @ centre.T + length * radius + SLACK * (1 + length)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[order], 1) - n[order]
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order, before < k, 1)
            last = batch.column("last").to_numpy(zero_copy_only=False)
            chosen = early if first else ~early & (bound >= last[:, None])
            i, j = np.nonzero(chosen)  # by query, then by shelf
            if not len(i):
                continue
            begin = np.nonzero(np.r_[True, (i[1:] != i[:-1]) | (shelf[j[1:]] != shelf[j[:-1]])])[0]
            cells = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(i)].astype(np.int32)), pa.array(cell[j]))
            own = [batch.column(x).take(pa.array(i[begin])) for x in ("query", "q", "part")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shelf[j[begin]]), cells], names=["query", "q", "part", "shelf", "cells"])

    return queries.mapInArrow(run, "query long, q array<float>, part int, shelf int, cells array<int>")


def _meet(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """query, candidate, similarity: from each meeting of queries and a shelf's block the `k` best of each query."""

    def products(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("candidate", pa.int64()), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        at = np.argsort(right.column("cell").to_numpy(), kind="stable")
        q, x, ids = matrix(left.column("q")), matrix(right.column("vector"))[at], right.column("id").to_numpy()[at]
        cell, first, place = np.unique(right.column("cell").to_numpy()[at], return_index=True, return_inverse=True)
        ends, names = np.r_[first[1:], len(x)], left.column("query").to_numpy()
        lists = left.column("cells").combine_chunks()
        who, what = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        here = np.isin(what, cell)
        reads = np.zeros((len(q), len(cell)), bool)
        reads[who[here], np.searchsorted(cell, what[here])] = True
        out = []
        for a, b in tiles(len(q), len(x)):
            mine = reads[a:b]
            if mine.mean() >= DENSE:
                s = q[a:b] @ x.T
                s[~mine[:, place]] = -np.inf
            else:
                s = np.full((b - a, len(x)), -np.inf)
                for c in np.nonzero(mine.any(0))[0]:
                    r = np.nonzero(mine[:, c])[0]
                    s[r, first[c] : ends[c]] = q[a:b][r] @ x[first[c] : ends[c]].T
            if len(x) > k:
                least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
                slack = SLACK * (1 + np.abs(np.where(np.isfinite(least), least, 0)) + np.sqrt((q[a:b] ** 2).sum(1)))
                i, j = np.nonzero((s >= (least - slack)[:, None]) & mine[:, place])
            else:
                i, j = np.nonzero(mine[:, place])
            out.append((names[a:b][i], ids[j], in_order(q[a:b], x, i, j)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    shelves = F.broadcast(visits.sparkSession.createDataFrame(_shelves(index), "cell int, shelf int, blocks int"))  # at most CELLS rows
    blocks = F.broadcast(shelves.groupBy("shelf").agg(F.max("blocks").alias("blocks")))
    visits = visits.join(blocks, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    needed = visits.select(F.col("shelf").alias("s"), F.col("block").alias("b"), F.col("part").alias("p")).distinct()
    members = index.members.join(shelves.select("cell", "shelf"), "cell")
    met = needed.join(members, (F.col("s") == F.col("shelf")) & (F.col("b") == F.col("block"))).select("s", "b", "p", "cell", "id", "vector")
    return visits.groupBy("shelf", "block", "part").cogroup(met.groupBy("s", "b", "p")).applyInArrow(products, "query long, candidate long, similarity double")


def nearest(queries: DataFrame, index: Index, k: int, id: str = "vec_id", vector: str = "embedding", block: int = SHELF) -> DataFrame:
    """query_id, candidate_id, similarity, rank: the `k` members with the largest inner product, ties by id, of every query."""
    rows = queries.select(F.col(id).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("q")).where("q is not null")
    parts = max(1, -(-rows.count() // block))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), F.asc("candidate")))
    top = lambda d: d.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)
    first = table(top(_meet(_visits(rows.withColumn("last", F.lit(0.0)), index, k, True), index, k)))
    last = first.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("similarity"))).alias("last"))
    again = rows.join(last, "query", "left").withColumn("last", F.coalesce("last", F.lit(float("-inf"))))
    rest = _meet(_visits(again, index, k, False), index, k)
    return top(first.drop("rank").unionByName(rest)).select(F.col("query").alias("query_id"), F.col("candidate").alias("candidate_id"), "similarity", "rank")


def visited(queries: DataFrame, index: Index, results: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> float:
    """Share of (query, cell) pairs that a search with these results reads at most."""
    rows = queries.select(F.col(id).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("q")).where("q is not null").withColumn("part", F.lit(0))
    last = results.where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("similarity").alias("last"))
    again = rows.join(last, "query", "left").withColumn("last", F.coalesce("last", F.lit(float("-inf"))))
    read_ = [_visits(again, index, k, first).agg(F.sum(F.size("cells"))).first()[0] or 0 for first in (True, False)]
    return sum(read_) / max(1, rows.count() * index.cells.count())
