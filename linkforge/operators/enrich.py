"""Enrichment joins and the incremental embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENRICHMENT = ("usable", "detected_sex", "detector_score", "blur_score", "quality_band", "face_width", "face_height")


def latest(summary: DataFrame, order: str = "processed_at") -> DataFrame:
    """One row for each record_id: the last."""
    last = W.partitionBy("record_id").orderBy(F.desc_nulls_last(order))
    return summary.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def enrich(registry: DataFrame, summary: DataFrame) -> DataFrame:
    """Every registry record, with those enrichment columns that the summary has."""
    have = [c for c in ENRICHMENT if c in summary.columns]
    return registry.drop(*have).join(latest(summary).select("record_id", *have), "record_id", "left")


def usable_vectors(summary: DataFrame, vectors: DataFrame) -> DataFrame:
    """The indexed gallery: usable records with a vector."""
    return vectors.join(summary.where("usable"), "record_id", "left_semi")


def _reusable():
    same = (F.col("c.image_sha256") == F.col("m.image_sha256")) & (F.col("c.model_version") == F.col("m.model_version"))
    return (F.col("c.record_id") == F.col("m.record_id")) & same & (~F.col("c.usable") | F.col("c.vector_exists"))


def cache_hits(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Records whose image and model are those of the cached run, which was unusable or has its vector."""
    return manifest.alias("m").join(cache.alias("c"), _reusable(), "left_semi")


def cache_misses(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    return manifest.alias("m").join(cache.alias("c"), _reusable(), "left_anti")


MODEL_VERSION = "pluggable-encoder-1"


def manifest_status(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Every record of (record_id, image_path) with its image, or with the reason that it has none."""
    d = manifest.join(images.select("record_id", "content", "image_sha256"), "record_id", "left")
    why = F.when(F.coalesce("image_path", F.lit("")) == "", "no_image_path").when(F.col("image_sha256").isNull(), "image_file_missing").when(F.length("content") == 0, "unreadable_image")
    return d.withColumn("failure_reason", why)


def build_summary(manifest: DataFrame, images: DataFrame, detections: DataFrame, cache: DataFrame, gate: dict | None = None, force: bool = False) -> DataFrame:
    """The sidecars of a run, a row for each record of the manifest: reused, newly assessed, or with the reason that it has none.

    `detections` has the best face of a record's image, if any. A record whose image and model are those of the
    cached run keeps its row (`reused`); `force` reuses none.
    """
    from ..functions import quality

    d = manifest_status(manifest, images).drop("content").withColumn("model_version", F.lit(MODEL_VERSION))
    old = cache.where(F.lit(not force))
    kept = cache_hits(d.where("failure_reason is null"), old).select("record_id").join(old.drop("vector_exists"), "record_id")
    kept = kept.select("record_id", "image_sha256", "model_version", "usable", "failure_reason", "quality_band", "detector_score", F.lit(True).alias("reused"))
    todo = d.join(kept, "record_id", "left_anti").join(detections, "record_id", "left")
    gate = gate or {}
    hard = {k: v for k, v in gate.items() if k != "min_blur"}
    size = [F.col(c) for c in ("face_width", "face_height", "detector_score")]
    none = F.when(F.col("face_width").isNull() & F.col("face_height").isNull() & F.col("detector_score").isNull(), "no_face_detected")
    why = F.coalesce("failure_reason", none, quality.failure(*size, **hard))
    assessed = quality.assessment(*size, F.col("blur_score"), F.col("landmarks_available"), **gate)
    band = F.when(why.isNotNull(), "unusable").otherwise(assessed["quality_band"])
    new = todo.select("record_id", "image_sha256", "model_version", why.isNull().alias("usable"), why.alias("failure_reason"), band.alias("quality_band"), "detector_score", F.lit(False).alias("reused"))
    return kept.unionByName(new)


def refreshed_vectors(summary: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors after a run: new ones, and old ones of reused usable rows and of records that the run didn't touch; stale ones are gone."""
    reused = summary.where("reused and usable").select("record_id")
    fresh = new.join(summary.where("usable and not reused").select("record_id"), "record_id", "left_semi")
    untouched = old.join(summary.select("record_id"), "record_id", "left_anti")
    return fresh.unionByName(old.join(reused, "record_id", "left_semi")).unionByName(untouched)


def best_face(faces: DataFrame, by: str = "record_id", score: str = "detector_score", order: str = "face_no") -> DataFrame:
    """The face of each image with the highest detector score, the first of equals."""
    best = W.partitionBy(by).orderBy(F.desc_nulls_last(score), F.asc(order))
    return faces.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def run_counts(summary: DataFrame) -> DataFrame:
    """Records of a run, how many the cache answered, and how many have a usable face."""
    return summary.agg(F.count(F.lit(1)).alias("records"), F.count_if("reused").alias("reused"), F.count_if("usable").alias("usable"))


def whole_image_faces(images: DataFrame) -> DataFrame:
    """Stand-in for a detector: every readable image is one sharp face of the encoder's size."""
    values = {"face_width": 112.0, "face_height": 112.0, "detector_score": 1.0, "blur_score": None}
    return images.where(F.length("content") > 0).select("record_id", *[F.lit(v).cast("double").alias(c) for c, v in values.items()], F.lit(None).cast("boolean").alias("landmarks_available"))


Encoder = Callable[[list[bytes]], list[list[float]]]


def encode(images: DataFrame, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """record_id, embedding of (record_id, content); the encoder is made once for each worker task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.DataFrame({"record_id": batch["record_id"], "embedding": encoder([bytes(x) if x is not None else b"" for x in batch["content"]])})

    return images.select("record_id", "content").mapInPandas(run, "record_id string, embedding array<float>")


def digest_encoder(dimension: int = 8) -> Encoder:
    """A deterministic stand-in where no model is installed: a unit vector from the content's digest."""
    import hashlib
    import math

    def run(contents: list[bytes]) -> list[list[float]]:
        out = []
        for c in contents:
            x = [b - 127.5 for b in hashlib.sha256(c).digest()[:dimension]]
            norm = math.sqrt(sum(v * v for v in x))
            out.append([v / norm for v in x])
        return out

    return run
