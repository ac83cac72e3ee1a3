import pytest
from pyspark.sql import functions as F

from linkforge.operators import review
from linkforge.schema import PERSON
from linkforge.sources import tables
from linkforge.streaming import review_log


def test_csv_dialect_and_missing_paths(spark, tmp_path):
    (tmp_path / "am.csv").write_text('record_id,name,age_min,location\nA1,"Ram ""R"" Lal",12,"two\nlines"\nA2,, x ,\n')
    rows = tables.read_registry(spark, f"{tmp_path}/am.csv").orderBy("record_id").collect()
    assert rows[0]["name"] == 'Ram "R" Lal' and rows[0]["location"] == "two\nlines" and rows[0]["age_min"] == 12.0 and rows[1]["name"] is None and rows[1]["age_min"] is None
    none = tables.read_registry(spark, f"{tmp_path}/none.csv")
    assert none.count() == 0 and none.schema == PERSON


def test_json_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"record_id": "a", "usable": true, "image_sha256": "x", "bbox": [1, 2]}')
    (tmp_path / "s/b.json").write_text("not json")
    assert [r["record_id"] for r in tables.read_sidecars(spark, f"{tmp_path}/s").collect()] == ["a"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/AM1.json").write_text('{"name": "n", "sections": {"Place": {" Province ": "Koshi", "District": ""}}}')
    registry = spark.createDataFrame([("AM1", "old", None), ("AM2", "kept", None)], "record_id string, location string, province string")
    out = {r["record_id"]: r for r in tables.backfill_location(registry, tables.read_details(spark, f"{tmp_path}/d"), {"province": ["Province"]}).collect()}
    assert out["AM1"]["location"] == "Koshi" and out["AM1"]["province"] == "Koshi" and out["AM2"]["location"] == "kept"


def test_list_import_pages_and_images(spark, tmp_path):
    details = "flood | 5 | नाम :- | नखुलेको | लिङ्ग:- | पुरुष | उमेर:- | ३०-३५ | अनुमानित उमेर:- | 28 | उचाइ :- | 5 ft 6 | 2082-05-12"
    rows = spark.createDataFrame([(details, "x_i4.jpg", 2)], "Details string, Image_Filename string, Page int")
    r = tables.import_list(rows).first()
    assert (r["record_id"], r["name"], r["sex"], r["age_min"], r["age_max"], r["height_cm"], r["event_date"], r["disaster_tag"]) == ("PM-LIST-p2-i4", None, "male", 28.0, 35.0, 167.6, "2082-05-12", "flood")
    page = '<h2>Name Here</h2><div><div class="card-title">Place</div><p><strong>Province:</strong><span> Koshi </span></p><p><strong>Ward :</strong> 5</p></div>'
    got = tables.html_sections(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert got[0]["name"] == "Name Here" and got[0]["sections"] == {"Place": {"Province": "Koshi", "Ward": "5"}} and got[1]["sections"] == {}
    nested = "<h3>A <b>B</b> C</h3><div class='card-body'><h5 class='card-title'>One</h5><div><strong>L :</strong><i>x</i><span>A<br>B <em>C</em></span></div><div><strong><u>M</u>:</strong> rest <b>of it</b></div></div><div><div class='card-title x'>Two</div><p><strong>N</strong><span>tail"
    got = tables.html_sections(spark.createDataFrame([(1, nested)], "page_id long, html string")).first()
    assert got["name"] == "A B C" and got["sections"] == {"One": {"L": "AB C", "M": "rest of it"}, "Two": {"N": "tail"}}
    (tmp_path / "AM7.jpg").write_bytes(b"abc")
    assert tables.read_images(spark, str(tmp_path)).select("record_id", "image_sha256").first()[0] == "AM7"


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_index(spark.createDataFrame([], "record_id string"), f"{tmp_path}/i")
    old, new = (spark.createDataFrame(x, "record_id string, usable boolean") for x in ([("a", True), ("b", True)], [("b", False)]))
    assert sorted(map(tuple, tables.merge_summary(old, new).collect())) == [("a", True), ("b", False)]
    tables.write_report({"recall_1": 0.5}, f"{tmp_path}/r")
    assert "0.5" in (tmp_path / "r.md").read_text() and "0.5" in (tmp_path / "r.json").read_text()
    registry = spark.createDataFrame([("a", "2083-05-12")], "record_id string, event_date string")
    once = tables.backfill_dates(registry)
    assert once.collect() == tables.backfill_dates(once.select("record_id", "event_date", "calendar_type", "event_date_normalized")).select(once.columns).collect()


def test_review_log_streams(spark, tmp_path):
    rows = [("PM1", "AM1", "Potential", "", None), ("PM1", "AM1", "rejected", "excluded", "n"), ("PM2", "AM1", "maybe", "", ""), ("PM2", "AM2", "rejected", "wrong", "")]
    bad = review.append(spark.createDataFrame(rows, "pm_record_id string, am_record_id string, decision string, forensic_status string, notes string"), f"{tmp_path}/log")
    assert sorted(r["error"] for r in bad.collect()) == ["invalid decision", "invalid forensic status"]
    log = spark.read.parquet(f"{tmp_path}/log")
    log.write.mode("append").parquet(f"{tmp_path}/log")  # delivered twice
    query = review_log.read(spark, f"{tmp_path}/log").writeStream.format("memory").queryName("reviews").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("reviews")
    assert got.count() == 2 and {r["ranking_model_version"] for r in got.collect()} == {"metadata-fusion-1"}
    assert review_log.decisions(got).agg(F.sum("reviews")).first()[0] == 2
    assert review_log.latest(log).count() == 1
