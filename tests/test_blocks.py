"""Products in blocks equal those by expressions."""

import random
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.functions import scoring
from linkforge.operators import blocks, pairs
from linkforge.plans import registry
from tests.test_bounds import full, plan_of, registry_rows

NAN = float("nan")


def vectors(spark, n, first, step, seed, odd=True):
    rng = np.random.default_rng(seed)
    x = [[float(np.float32(a)) for a in v] for v in rng.normal(size=(n, 6)) / 3]
    x[3:9] = [x[1]] * 6  # ties
    if odd:
        x[10:14] = [None, [0.5], [0.1, None, 0.2, 0.3, 0.4, 0.5], [NAN, 0.0, 0.0, 0.0, 0.0, 0.0]]
    return spark.createDataFrame([(first + step * i, v, None if i % 7 == 0 else i % 4) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def rows(df):
    return sorted((repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()))


def both_ways(monkeypatch, make, small=True):
    monkeypatch.setattr(blocks, "PAIRS", 1 << 40)
    want = rows(make())
    monkeypatch.setattr(blocks, "PAIRS", 0)
    for name, n in (("PART", 16), ("BLOCK", 32), ("SLIM_PART", 64), ("SLIM_BLOCK", 128)) if small else ():
        monkeypatch.setattr(blocks, name, n)
    made = make()
    assert rows(made) == want and want
    return plan_of(made)


@pytest.mark.parametrize("odd", [True, False])
def test_vector_topk(spark, monkeypatch, odd):
    q, c = vectors(spark, 60, 0, 2, 1, odd), vectors(spark, 150, 1, 2, 2, odd)
    plan = both_ways(monkeypatch, lambda: pairs.vector_topk(q, c, 7))
    assert odd or "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("odd", [True, False])
def test_max_per_group(spark, monkeypatch, odd):
    q, c = vectors(spark, 60, 0, 2, 1, odd), vectors(spark, 150, 1, 2, 2, odd).withColumnRenamed("label", "group")
    plan = both_ways(monkeypatch, lambda: pairs.max_per_group(q, c, 4))
    assert odd or "NestedLoopJoin" not in plan


@pytest.mark.parametrize("odd", [True, False])
def test_rank_of_right(spark, monkeypatch, odd):
    q, c = vectors(spark, 60, 0, 2, 1, odd), vectors(spark, 150, 1, 2, 2, odd)
    truth = q.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") * 7 % 300 - F.col("vec_id") * 7 % 2 + 1).alias("correct_id"))

    def scores(face, query, candidate):
        return [face, ((query + candidate) % 3) / 2.0, 0.6 * face + 0.4 * (((query + candidate) % 3) / 2.0)]

    def make():
        return pairs.rank_of_right(q, c, truth, ("a", "b", "c"), scores)

    plan = both_ways(monkeypatch, make)
    assert odd or "NestedLoopJoin" not in plan
    assert make().where("rank is not null").count() > 5 and make().count() == 180


@pytest.mark.parametrize("name", ["vector_topk", "max_per_person", "ablation", "recall_at_k", "mrr", "threshold_recall"])
def test_queries_over_vectors_make_no_pairs(spark, monkeypatch, name):
    plan = both_ways(monkeypatch, lambda: registry.QUERIES[name](spark, "/root/testdata/sf0.01"), small=False)
    nested = [line for line in plan.splitlines() if "NestedLoopJoin" in line]
    assert "FlatMapCoGroupsInArrow" in plan and len(nested) <= (name == "threshold_recall")  # the grid of thresholds


def test_rounded_halves_go_up():
    v = np.array([0.00005, 0.12345, 0.12344999999, 0.7, 1.0, 0.0, 0.99995])
    assert blocks.rounded(v).tolist() == [float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for x in v.tolist()]


def test_metadata_scores_never_lie_between():
    bands, days = [*[s for _, s in scoring.BANDS], 0.5], [0.2, 0.5, *[s for _, s in scoring.DATE_BANDS]]
    for parts in product((0.0, 0.5, 1.0), bands, bands, days, (1.0, 0.8, 0.75, 0.6, 0.55, 0.5, 0.35, 0.25)):
        x = sum(w * p for w, p in zip(scoring.WEIGHTS.values(), parts)) / 0.005
        assert abs(x - round(x)) < 1e-9


@pytest.mark.parametrize(("odd", "k", "least"), [(True, 3, 0.0), (False, 5, 0.8), (True, 400, 0.3)])
def test_metadata_search(spark, monkeypatch, odd, k, least):
    """Both ways equal the full product; blocks make no pair as a row."""
    a, p = registry_rows(spark, "A", 900, 1, odd), registry_rows(spark, "P", 60, 2, odd)
    monkeypatch.setattr(blocks, "PAIRS", 0)
    monkeypatch.setattr(blocks, "SLIM_PART", 64)
    monkeypatch.setattr(blocks, "SLIM_BLOCK", 128)
    got = pairs.metadata_search(a, p, k, least)
    assert "FlatMapCoGroupsInArrow" in plan_of(got)
    want = full(a, p, k, least).select(F.concat(F.lit("P"), "query_pos").alias("p"), F.concat(F.lit("A"), "candidate_pos").alias("a"), "rank", "final_score")
    assert rows(got.select(F.col("am_record_id").alias("a"), F.col("pm_record_id").alias("p"), "rank", "final_score")) == rows(want)


@pytest.mark.parametrize(("side", "stage", "odd"), [("both", "all", True), ("pm", 6, True), ("am", "all", False)])
def test_search(spark, monkeypatch, side, stage, odd):
    """Faces, metadata, records without a vector and vectors that are no plain ones."""
    a, p = registry_rows(spark, "A", 150, 1, True), registry_rows(spark, "P", 70, 2, True)
    v = F.when(F.col("pos") % 5 != 0, F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.cos(i * (F.col("pos") % 40 + 1)).cast("float") / 3).cast("array<float>"))
    if odd:
        v = F.when(F.col("pos") == 7, F.array(F.lit(0.5)).cast("array<float>")).when(F.col("pos") == 8, F.array(*[F.lit(None).cast("float")] * 6)).otherwise(v)
    a, p = a.withColumn("embedding", v), p.withColumn("embedding", v)
    plan = both_ways(monkeypatch, lambda: pairs.search(a, p, side, 4, stage))
    assert odd or "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_sql_shortlist(spark, monkeypatch):
    plan = both_ways(monkeypatch, lambda: registry.QUERIES["sql_shortlist"](spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan
