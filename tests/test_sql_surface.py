"""SQL functions equal the DataFrame expressions."""

from pyspark.sql import functions as F

from linkforge import sql
from linkforge.functions import scoring, text
from linkforge.operators import pairs

from .test_bounds import registry_rows


def test_scores_of_odd_rows(spark):
    sql.install(spark)
    sql.install(spark)
    a, p = registry_rows(spark, "A", 40, 5, True), registry_rows(spark, "P", 40, 6, True)
    got = spark.sql(sql.SHORTLIST, am=a, pm=p, k=1000).select("am_record_id", "pm_record_id", "final_score")
    want = pairs.metadata_scores(pairs.cross(pairs.prefixed(a, "am_"), pairs.prefixed(p, "pm_"))).select("am_record_id", "pm_record_id", "final_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_and_provinces(spark):
    sql.install(spark)
    rows = [("Kavre, Bagmati.",), (None,), (" : ",), ("बागमती प्रदेश",), ("प्रदेश नं २ / x",)]
    d = spark.createDataFrame(rows, "s string")
    from linkforge.functions.location import canonical_province

    got = d.select(F.expr("normal_text(s)").alias("n"), F.expr("canonical_province(normal_text(s))").alias("c")).collect()
    assert got == d.select(F.nullif(text.normalize_ascii(F.col("s")), F.lit("")).alias("n"), canonical_province(F.nullif(text.normalize_ascii(F.col("s")), F.lit(""))).alias("c")).collect()
    one = spark.sql("SELECT age_middle(20, 0), age_middle(null, 5), face_score(3.0D), fusion_score(null, 0.3D), band_score(CAST('NaN' AS DOUBLE))").first()
    assert tuple(one) == (20.0, None, 1.0, 0.3, scoring.BANDS[-1][1])


def test_label_rows(spark):
    sql.install(spark)
    rows = [(1, "flood| 12 |Name:-|Ram |, B|Age :-|| Name:- | Kumar,"), (2, "none"), (3, None), (4, "A:-")]
    d = spark.createDataFrame(rows, "id int, details string")
    d.createOrReplaceTempView("list_rows")
    got = {(r["id"], r["label"]): r["value"] for r in spark.sql("SELECT id, l.* FROM list_rows, LATERAL label_rows(details) l").collect()}
    want = d.where("details is not null").select("id", F.explode(text.label_values(text.tokens(F.col("details")))))
    assert got == {(r["id"], r["key"]): r["value"] for r in want.collect()} and got[1, "Name"] == "Ram , B Kumar"
