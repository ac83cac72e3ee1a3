"""Recall, MRR, ablation and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality

AT = (1, 5, 10, 20)


def truth_ranks(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each ground-truth row with the rank of its correct candidate, NULL where it isn't among them."""
    key = ["query_type", "query_record_id", "correct_candidate_record_id"]
    found = candidates.select("query_type", "query_record_id", F.col("candidate_record_id").alias("correct_candidate_record_id"), "rank")
    return truth.join(found, key, "left")


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Recall@K over all queries, MRR over those found, and their number."""
    recall = [F.coalesce(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"recall_{k}") for k in AT]
    mrr = F.coalesce(F.avg(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *recall, mrr)


#: Thresholds of the sweep; no blur threshold is one of them.
SWEEP_SCORES, SWEEP_BLURS = (0.0, 0.5, 0.7), (None, 20.0, 50.0)


def _swept(rows: DataFrame, scores: tuple, blurs: tuple) -> DataFrame:
    """`rows` beside each pair of thresholds, with `ok`: the face stays usable."""
    grid = rows.sparkSession.createDataFrame([(float(s), None if b is None else float(b)) for s in scores for b in blurs], "min_score double, min_blur double")
    w, h, s, b = (F.col(c) for c in ("face_width", "face_height", "detector_score", "blur_score"))
    ok = quality.failure(w, h, s, min_score=F.col("min_score")).isNull() & F.coalesce(b >= F.col("min_blur"), F.lit(True))
    return rows.crossJoin(F.broadcast(grid)).withColumn("ok", ok)  # as many rows as there are pairs of thresholds


def threshold_sweep(detections: DataFrame, scores: tuple = SWEEP_SCORES, blurs: tuple = SWEEP_BLURS, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of faces that stay usable for each pair of thresholds, and for each value of `by`, as the side."""
    d = _swept(detections, scores, blurs)
    return d.groupBy(*by, "min_score", "min_blur").agg(F.avg(F.col("ok").cast("double")).alias("enrolment_rate"), F.count(F.lit(1)).alias("faces"))


def threshold_recall(detections: DataFrame, ranks: DataFrame, key: str, scores: tuple = SWEEP_SCORES, blurs: tuple = SWEEP_BLURS, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall@K over the queries whose face stays usable, for each pair of thresholds, and for each value of `by`, as the condition: what enrolment costs and gains.

    `ranks` has a row for each query with its `rank` (NULL where the right candidate isn't found); both sides share `key`.
    """
    d = _swept(ranks.join(detections, key), scores, blurs)
    recall = [F.coalesce(F.avg(F.when(F.col("ok"), F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))), F.lit(0.0)).alias(f"recall_{k}") for k in AT]
    return d.groupBy(*by, "min_score", "min_blur").agg(F.count_if("ok").alias("enrolled"), *recall)
