"""The driver's tables as two registries. The same SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

AM = """
SELECT CONCAT('AM', CAST(c.c_custkey AS STRING)) AS record_id, c.c_custkey AS pos, c.c_name AS name,
  CASE c.c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex,
  CASE WHEN c.c_custkey % 7 < 3 THEN 'male' WHEN c.c_custkey % 7 < 5 THEN 'female' END AS detected_sex,
  CASE WHEN c.c_custkey % 4 <> 3 THEN CAST(18 + (c.c_custkey * 7) % 50 AS DOUBLE) END AS age_min,
  CASE WHEN c.c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN c.c_custkey % 4 <> 3 THEN CAST(18 + (c.c_custkey * 7) % 50 + c.c_custkey % 9 AS DOUBLE) END AS age_max,
  CASE WHEN c.c_custkey % 5 <> 4 THEN CAST(150 + (c.c_custkey * 3) % 45 AS DOUBLE) END AS height_cm,
  d.event_day AS event_day,
  CONCAT(r.r_name, ' ', n.n_name) AS location, r.r_name AS province, n.n_name AS district,
  CASE WHEN c.c_custkey % 10 = 0 THEN CONCAT(n.n_name, ' metro') END AS municipality,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'blue shirt' END AS clothing,
  CASE WHEN c.c_custkey % 9 = 0 THEN 'scar' END AS distinguishing_marks,
  e.embedding AS embedding
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS event_day FROM {orders} GROUP BY o_custkey) d ON d.o_custkey = c.c_custkey
LEFT JOIN (SELECT vec_id, embedding FROM {embeddings} WHERE vec_id % 2 = 0) e ON e.vec_id = c.c_custkey
"""

PM = """
SELECT CONCAT('PM', CAST(s.s_suppkey AS STRING)) AS record_id, s.s_suppkey AS pos, s.s_name AS name,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' END AS sex,
  CASE WHEN s.s_suppkey % 5 < 2 THEN 'male' WHEN s.s_suppkey % 5 < 4 THEN 'female' END AS detected_sex,
  CASE WHEN s.s_suppkey % 4 <> 2 THEN CAST(20 + (s.s_suppkey * 11) % 45 AS DOUBLE) END AS age_min,
  CASE WHEN s.s_suppkey % 4 <> 2 AND s.s_suppkey % 3 <> 0 THEN CAST(20 + (s.s_suppkey * 11) % 45 + 5 AS DOUBLE) END AS age_max,
  CASE WHEN s.s_suppkey % 6 <> 1 THEN CAST(152 + (s.s_suppkey * 5) % 40 AS DOUBLE) END AS height_cm,
  d.event_day AS event_day,
  CASE WHEN s.s_suppkey % 9 <> 5 THEN CONCAT('near ', n.n_name, ', ', r.r_name) END AS location,
  CAST(NULL AS STRING) AS province, CASE WHEN s.s_suppkey % 8 = 0 THEN n.n_name END AS district, CAST(NULL AS STRING) AS municipality,
  CASE WHEN s.s_suppkey % 2 = 0 THEN 'jeans' END AS clothing, CASE WHEN s.s_suppkey % 5 = 0 THEN 'tattoo' END AS distinguishing_marks,
  e.embedding AS embedding
FROM {supplier} s
JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_suppkey, CAST(MIN(l_shipdate) AS DATE) AS event_day FROM {lineitem} GROUP BY l_suppkey) d ON d.l_suppkey = s.s_suppkey
LEFT JOIN (SELECT vec_id, embedding FROM {embeddings} WHERE vec_id % 2 = 1) e ON e.vec_id = s.s_suppkey
"""

#: Faces found by a detector, from the event stream.
DETECTIONS = """
SELECT event_id AS record_key, CONCAT('E', CAST(event_id AS STRING)) AS record_id, event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS detector_score,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(20 + (event_id * 13) % 90 AS DOUBLE) END AS face_width,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(25 + (event_id * 19) % 90 AS DOUBLE) END AS face_height,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 7) % 200 AS DOUBLE) END AS blur_score,
  CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS landmarks_available
FROM {events}
"""

#: What a first embedding run over the documents' images left behind.
CACHE = """
SELECT CONCAT('D', CAST(doc_id AS STRING)) AS record_id,
  CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE SHA2(text, 256) END AS image_sha256,
  CASE WHEN doc_id % 11 = 0 THEN 'encoder-0' ELSE 'pluggable-encoder-1' END AS model_version,
  doc_id % 3 <> 0 AS usable, doc_id % 13 <> 0 AS vector_exists
FROM {documents} WHERE doc_id % 5 <> 0
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view's SQL over the tables that it names."""
    return spark.sql(text, **tables(spark, sf_dir, *[n for n in TABLES if "{" + n + "}" in text]))


def am(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, AM)


def pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PM)


def oracle(text: str) -> str:
    for n in TABLES:
        text = text.replace("{" + n + "}", n)
    return text.replace("SHA2(text, 256)", "sha256(text)")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id"), "embedding", "label")
