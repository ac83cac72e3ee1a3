"""The bounded ranking equals the full product and makes little of it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from linkforge.functions import text
from linkforge.operators import pairs
from linkforge.plans import registry

FIELDS = "record_id string, pos long, sex string, detected_sex string, age_min double, age_max double, height_cm double, event_day date, location string, province string, district string, municipality string, embedding array<float>"


def registry_rows(spark, name, n, seed, odd=False):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    inf, nan = float("inf"), float("nan")

    def one(k):
        day = rng.choice([None, *range(0, 120, 3)])
        place = rng.choice([None, "Bagmati, Kavre", "near Kavre Bagmati", "Koshi", "Koshi Ilam"])
        age = some(20.0, 24.99, 25.0, 30.0, 44.5, *((nan, inf, -inf, 1e7) if odd else ()))
        height = some(150.0, 155.0, 160.01, 170.0, *((nan, inf, -inf) if odd else ()))
        return (
            f"{name}{k}", k, some("male", "female"), some("male", "female"), age, some(0.0, 40.0), height, None if day is None else datetime.date(2024, 1, 1) + datetime.timedelta(day),
            place, some("Bagmati", "Koshi"), some("Kavre", "Ilam"), some("Ilam town"), None,
        )

    return pairs.prepare(spark.createDataFrame([one(k) for k in range(n)], FIELDS), text.normalize_ascii)


def full(a, p, k, least):
    d = pairs.metadata_scores(pairs.cross(pairs.prefixed(a, "am_"), pairs.prefixed(p, "pm_"))).where(F.col("final_score") >= least)
    return pairs.ranked(pairs.narrow(d, "pm_", "am_"), k, ["query_pos"], [F.desc("final_score"), F.asc("candidate_pos")])


@pytest.mark.parametrize(("odd", "k", "least"), [(True, 3, 0.0), (False, 5, 0.8), (True, 400, 0.3)])
def test_bounded_equals_the_product(spark, odd, k, least):
    a, p = registry_rows(spark, "A", 900, 1, odd), registry_rows(spark, "P", 60, 2, odd)
    got = pairs.metadata_search(a, p, k, least).select("pm_record_id", "am_record_id", "rank", "final_score")
    want = full(a, p, k, least).select(F.concat(F.lit("P"), "query_pos").alias("p"), F.concat(F.lit("A"), "candidate_pos").alias("a"), "rank", "final_score")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and (least or len(rows) == 60 * min(k, 900))


def test_bounded_in_the_other_direction(spark):
    """AM queries, a PM gallery with many records a class."""
    a, p = registry_rows(spark, "A", 40, 3, True), registry_rows(spark, "P", 3000, 4)
    ta, tp = (pairs.classed(pairs.prefixed(x, s), s) for x, s in ((a, "am_"), (p, "pm_")))
    got = pairs.bounded(ta, tp, "am_", "pm_", 9).select("query_pos", "candidate_pos", "rank", "final_score")
    d = pairs.metadata_scores(pairs.cross(pairs.prefixed(a, "am_"), pairs.prefixed(p, "pm_")))
    want = pairs.ranked(pairs.narrow(d, "am_", "pm_"), 9, ["query_pos"], [F.desc("final_score"), F.asc("candidate_pos")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("query_pos", "candidate_pos", "rank", "final_score").collect()))


def test_little_of_the_product_is_scored(spark):
    a, p = registry.sides(spark, "/root/testdata/sf0.1")
    seen = []

    def found(d):
        seen.append(d)
        return d

    pairs.metadata_search(a, p, 20, 0.0, found)
    assert len(seen) == 2 and 0 < sum(d.count() for d in seen) < 0.1 * 15_000 * 1_000


def test_empty_sides(spark):
    a, p = registry_rows(spark, "A", 5, 1), registry_rows(spark, "P", 5, 2)
    assert pairs.metadata_search(a.limit(0), p).count() == 0 == pairs.metadata_search(a, p.limit(0)).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_meet_once_for_both_directions(spark):
    df = pairs.search(*registry.sides(spark, registry_dir()), "both")
    plan = plan_of(df)
    assert sum("similarity" in line or "NestedLoop" in line for line in plan.splitlines() if "NestedLoopJoin" in line) == 1


def test_first_stage_is_limited_before_its_shuffle(spark):
    plan = plan_of(pairs.search(*registry.sides(spark, registry_dir()), "pm", first_stage=3))
    assert "WindowGroupLimit" in plan and "row_number(), 3, Partial" in plan


def registry_dir():
    return "/root/testdata/sf0.001"
