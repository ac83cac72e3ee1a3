"""Face quality gate and banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_FACE_SIZE, MIN_DETECTOR_SCORE = 40.0, 0.5
#: Margins over the gate inside which a face is flagged.
SCORE_MARGIN, SIZE_FACTOR = 0.15, 1.5


def failure(width: Column, height: Column, score: Column, min_size: float = MIN_FACE_SIZE, min_score: float = MIN_DETECTOR_SCORE) -> Column:
    small = width.isNull() | height.isNull() | (width < min_size) | (height < min_size)
    return F.when(small, "face_too_small").when(score.isNull() | (score < min_score), "low_detector_confidence")


def flags(width: Column, height: Column, score: Column, blur: Column, landmarks: Column, min_size: float = MIN_FACE_SIZE, min_score: float = MIN_DETECTOR_SCORE, min_blur: float | None = None) -> Column:
    """Names of the soft flags of a face that passes the gate, in their order."""
    blurry = (blur < min_blur) if min_blur is not None else F.lit(False)
    return F.array_compact(
        F.array(
            F.when(blurry, "blurry"),
            F.when(score < min_score + SCORE_MARGIN, "borderline_detector_confidence"),
            F.when(F.least(width, height) < SIZE_FACTOR * min_size, "small_face_margin"),
            F.when(landmarks == F.lit(False), "no_landmarks"),
        )
    )


def assessment(width: Column, height: Column, score: Column, blur: Column, landmarks: Column, **gate) -> Column:
    """STRUCT<usable, quality_band, quality_reasons>."""
    hard = {k: v for k, v in gate.items() if k != "min_blur"}
    why, soft = failure(width, height, score, **hard), flags(width, height, score, blur, landmarks, **gate)
    band = F.when(why.isNotNull(), "unusable").when(F.size(soft) == 0, "good").when(F.size(soft) == 1, "moderate").otherwise("poor")
    return F.struct(why.isNull().alias("usable"), band.alias("quality_band"), F.when(why.isNotNull(), F.array(why)).otherwise(soft).alias("quality_reasons"))
