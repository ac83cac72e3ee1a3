"""Reviewer decisions: canonical values, validation, audit stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FACE_MODEL_VERSION, RANKING_VERSION

# Accepted spellings of a decision, and the forensic states.
DECISIONS = {
    "potential": "potential",
    "candidate_for_further_examination": "potential",
    "candidate for further examination": "potential",
    "rejected": "rejected",
    "not_likely_candidate": "rejected",
    "not a likely candidate": "rejected",
    "inconclusive": "inconclusive",
    "insufficient_evidence": "inconclusive",
    "insufficient evidence": "inconclusive",
}
STATUSES = ("", "not_examined", "fingerprint_requested", "dental_requested", "dna_requested", "excluded", "confirmed_externally")
SEXES = ("", "male", "female", "other", "unspecified")
IMAGES = r"\.(jpg|jpeg|png|webp)$"
MAX_UPLOAD = 10 * 1024 * 1024


def canonical_decision(c: Column) -> Column:
    """NULL where the decision is none of the accepted ones."""
    known = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    plain = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(known, F.regexp_replace(plain, "[ -]", "_")), F.try_element_at(known, plain))


def valid_status(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin(*STATUSES)


def validate(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted reviews, stamped for the audit, and rejected ones with their error."""
    d = reviews.withColumn("_d", canonical_decision(F.col("decision"))).withColumn("error", F.when(F.col("_d").isNull(), "invalid decision").when(~valid_status(F.col("forensic_status")), "invalid forensic status"))
    good = d.where("error is null").select(
        F.uuid().alias("review_id"), "pm_record_id", "am_record_id", F.col("_d").alias("decision"), F.coalesce("forensic_status", F.lit("")).alias("forensic_status"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reviewed_at"), F.lit(RANKING_VERSION).alias("ranking_model_version"), F.lit(FACE_MODEL_VERSION).alias("face_model_version"),
    )
    return good, d.where("error is not null").drop("_d")


def append(reviews: DataFrame, path: str) -> DataFrame:
    """Append the accepted reviews to the log; returns the rejected ones."""
    good, bad = validate(reviews)
    good.write.mode("append").parquet(path)
    return bad


def upload_error(requests: DataFrame) -> DataFrame:
    """(name, content, content_type, target, sex) with `error`, NULL where the request is valid."""
    image = F.lower("name").rlike(IMAGES) | F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    return requests.withColumn(
        "error",
        F.when(~F.col("target").isin("pm", "am"), "invalid target")
        .when(~F.coalesce(F.lower("sex"), F.lit("")).isin(*SEXES), "invalid sex")
        .when(~image, "unsupported file type")
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty file")
        .when(F.length("content") > MAX_UPLOAD, "file too large"),
    )


def upload_review_id(name: Column) -> Column:
    return F.concat(F.lit("UPLOAD:"), F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unnamed")))
