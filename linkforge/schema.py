"""Schemas of the registries and side tables; missing values are NULL from ingestion on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType(), "float": T.FloatType()}
_KINDS |= {f"array<{k}>": T.ArrayType(v) for k, v in _KINDS.items()}


def _struct(columns: str) -> T.StructType:
    """`name kind, ...`; workers import this module too, where no session could parse DDL."""
    return T.StructType([T.StructField(c, _KINDS[kind]) for c, kind in (x.split() for x in columns.split(", "))])


_PERSON_TEXT = "record_id record_type name sex"
_PERSON_REST = "event_date raw_event_date calendar_type event_date_normalized location province district municipality ward clothing distinguishing_marks image_path image_sha256 source_ref scraped_at current_facility disaster_tag"

PERSON = T.StructType(
    [T.StructField(c, T.StringType()) for c in _PERSON_TEXT.split()]
    + [T.StructField(c, T.DoubleType()) for c in ("age_min", "age_max", "height_cm")]
    + [T.StructField(c, T.StringType()) for c in _PERSON_REST.split()]
)

EMBEDDING_SUMMARY = _struct(
    "record_id string, usable boolean, failure_reason string, detector_score double, face_width double, face_height double, blur_score double, detected_sex string, quality_band string, processed_at string"
)

SIDECAR = _struct(
    "record_id string, usable boolean, failure_reason string, detector_score double, face_width double, face_height double, blur_score double, detected_sex string, quality_band string, processed_at string, "
    "model_name string, model_version string, image_sha256 string, embedding_dimension int, bbox array<int>, quality_reasons array<string>, landmarks_available boolean, vector_exists boolean"
)

VECTOR = _struct("record_id string, embedding array<float>")

GROUND_TRUTH = _struct("query_record_id string, query_type string, correct_candidate_record_id string, candidate_type string, condition string")

REVIEW = _struct(
    "review_id string, pm_record_id string, am_record_id string, decision string, forensic_status string, notes string, reviewed_at string, ranking_model_version string, face_model_version string"
)

LIST_ROW = _struct("Details string, Image_Filename string, Page int")

DETAIL_JSON = "struct<name:string,sections:map<string,map<string,string>>>"

CANDIDATE_COLUMNS = (
    "query_type query_record_id candidate_type candidate_record_id rank face_score metadata_score final_score sex_score age_score height_score date_score location_score "
    "am_metadata_vision_conflict pm_metadata_vision_conflict pair_metadata_conflict pair_vision_conflict candidate_source"
).split()

#: Doubled quotes inside quotes and line feeds in cells.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}

#: Stamped on every review.
RANKING_VERSION, FACE_MODEL_VERSION = "metadata-fusion-1", "pluggable-encoder-1"


def nulls(df: DataFrame) -> DataFrame:
    """Blank strings become NULL, which stands for unknown everywhere."""
    return df.select(*[F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`, those that `df` lacks as typed NULL; unparsable numbers are NULL."""
    have = dict(df.dtypes)
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if have[f.name] == "string" and not isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)
    return df.select(*[(cast(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
