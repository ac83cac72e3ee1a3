"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into `CELLS` equal cells. A shard owns the arcs before its virtual nodes; a key
belongs to the arc of its cell. A shard's load is bounded by its even share of the rows, so that
counts differ by one at most (law `rows`), and what an arc's shard can't take continues clockwise
to the next virtual node, and so on. Adding a shard moves the keys of the arcs that it takes over
and the overflow that the new bounds shift.

Only the number of rows in each cell, `CELLS` numbers whatever the corpus, goes to the driver for the
walk around the ring; rows are ranked and placed by DataFrame operations.

A null text has no bytes and a null crc; a null doc_id is hashed as such. Rows with equal doc_id are
placed one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELLS = 1 << 16
VIRTUAL = 64
SHARDS = 24


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise."""
    rows = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(CELLS)).alias("cell"))
        .collect()
    )
    return sorted((r["cell"], r["shard"]) for r in rows)


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, ranks, shard, first slot) for all rows, with every shard at its bound."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    at = [c for c, _ in nodes]
    waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for cell in sorted(counts):
        waiting[bisect_left(at, cell) % len(nodes)].append((cell, 0, counts[cell]))
    out: list[tuple[int, int, int, int, int]] = []
    filled = [0] * shards
    while waiting:
        # all arcs serve what has come to them, in ring order; what is left goes on to the next
        after: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k in sorted(waiting):
            shard = nodes[k][1]
            for cell, lo, n in waiting[k]:
                take = min(n, room[shard])
                if take:
                    out.append((cell, lo, take, shard, filled[shard]))
                    filled[shard] += take
                    room[shard] -= take
                if n > take:
                    after[(k + 1) % len(nodes)].append((cell, lo + take, n - take))
        waiting = after
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    raw = F.col(text).cast("binary")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit("key"), F.col(doc_id)).alias("hash"),
    ).withColumn("cell", F.pmod(F.shiftrightunsigned("hash", 48), F.lit(CELLS)).cast("long"))
    counts = {r["cell"]: r["n"] for r in docs.select(F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("key"), F.col(doc_id)), 48), F.lit(CELLS)).cast("long").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    runs = walk(counts, ring(spark, shards, virtual), shards)
    placed = spark.createDataFrame(runs, "cell long, lo long, n long, shard int, slot0 long")
    order = W.partitionBy("cell").orderBy("hash", "doc_id", "size", "text_crc32")
    own = slim.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    hit = (own["cell"] == placed["cell"]) & (own["rank"] >= placed["lo"]) & (own["rank"] < placed["lo"] + placed["n"])
    # about CELLS rows: every cell has one run and some are split where a shard was full
    return own.join(F.broadcast(placed), hit).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
