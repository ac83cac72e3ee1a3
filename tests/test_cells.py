"""The cell index gives what a full scan gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.operators import cells, pairs


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def clustered(n, groups, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, 24))[rng.integers(0, groups, n)] + 0.1 * rng.normal(size=(n, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["candidate_id"], r["similarity"]) for r in df.collect())


@pytest.mark.parametrize("unit", [True, False])
def test_equals_the_scan(spark, unit):
    x = clustered(1500, 30, 1)
    x = x if unit else x * np.random.default_rng(2).uniform(0.1, 3, (1500, 1))
    x[700:740] = x[5]  # ties
    gallery, queries = frame(spark, [*x, None], 10_000), frame(spark, [*x[:60], *clustered(20, 3, 9), None])
    index = cells.build(gallery, block=50)
    got = cells.nearest(queries, index, 12, block=32)
    assert rows(got) == rows(pairs.vector_topk(queries.where("embedding is not null"), gallery.where("embedding is not null"), 12))
    assert not unit or cells.visited(queries, index, got, 12) < 0.5


def test_written_index_and_small_ones(spark, tmp_path):
    x = clustered(40, 4, 3)
    gallery = frame(spark, x)
    cells.build(gallery).write(f"{tmp_path}/i")
    index = cells.read(spark, f"{tmp_path}/i")
    assert rows(cells.nearest(gallery, index, 100)) == rows(pairs.vector_topk(gallery, gallery, 100))
    assert cells.read(spark, f"{tmp_path}/none") is None
    assert cells.nearest(gallery, cells.build(gallery.limit(0)), 3).count() == 0 == cells.nearest(gallery.where(F.lit(False)), index, 3).count()


def test_a_query_travels_once_for_each_shelf(spark, monkeypatch):
    """Vectors without structure, where no cell can be skipped: visits come in small batches, a row for each shelf and not for each cell."""
    x = np.random.default_rng(4).normal(size=(900, 8))
    gallery, queries = frame(spark, x, 10_000), frame(spark, x[:50])
    monkeypatch.setattr(cells, "SHELF", 300)
    index = cells.build(gallery)
    last = queries.selectExpr("vec_id AS query", "embedding AS q", "0 AS part", "double('-inf') AS last")
    rest = cells._visits(last, index, 5, False)
    assert index.cells.count() == 30 and rest.groupBy("query").count().agg(F.max("count")).first()[0] <= 5
    assert rows(cells.nearest(queries, index, 5, block=32)) == rows(pairs.vector_topk(queries, gallery, 5))
