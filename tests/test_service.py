import pytest
from pyspark.sql import functions as F

from linkforge.__main__ import main
from linkforge.operators import enrich
from linkforge.plans import adapter
from linkforge.service import Engine
from linkforge.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(adapter.am(spark, SF).cache(), adapter.pm(spark, SF).cache())


def test_stats_and_pages(engine):
    rows = {r["side"]: r for r in engine.stats().collect()}
    assert rows["am"]["records"] == 150 and rows["pm"]["records"] == 10 and rows["am"]["indexed"] == 75
    total, page = engine.list_records("am", 5, 10)
    assert total == 150 and [r["record_id"] for r in page.collect()] == [f"AM{k}" for k in range(10, 15)]


def test_candidates_and_uploads(spark, engine):
    rows = engine.candidates("pm", "PM1", 3).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and all(r["reasons"] and "DNA" in r["missing_evidence"] for r in rows)
    with pytest.raises(KeyError):
        engine.candidates("am", "nobody")
    with pytest.raises(ValueError):
        engine.registry("xx")
    one = engine.pm.where("record_id = 'PM3'").withColumns({"record_id": F.lit("UPLOAD"), "sex": F.lit("Unspecified")})
    top = engine.upload(one, "am", 7)
    assert top.count() == 7 and {r["query_record_id"] for r in top.collect()} == {"UPLOAD"}


def test_reviews(spark, tmp_path, engine):
    e = Engine(engine.am, engine.pm, f"{tmp_path}/log")
    bad = e.append_reviews(spark.createDataFrame([("PM1", "AM1", "potential", "", ""), ("PM1", "AM2", "?", "", "")], "pm_record_id string, am_record_id string, decision string, forensic_status string, notes string"))
    assert len(bad) == 1 and e.stats().first()["reviews"] == 1


def test_images_faces_and_counts(spark):
    manifest = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y"), ("d", "z")], "record_id string, image_path string")
    images = spark.createDataFrame([("a", b"1", "h"), ("d", b"", "e")], "record_id string, content binary, image_sha256 string")
    got = {r["record_id"]: r["failure_reason"] for r in enrich.manifest_status(manifest, images).collect()}
    assert got == {"a": None, "b": "no_image_path", "c": "image_file_missing", "d": "unreadable_image"}
    faces = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.9), ("b", 0, None)], "record_id string, face_no int, detector_score double")
    assert {r["record_id"]: r["face_no"] for r in enrich.best_face(faces).collect()} == {"a": 1, "b": 0}


def test_detail_import(spark):
    page = ("AM7", " Some  Name ", {"Person": {" लिङ्ग ": "पुरुष", "उमेर": "३० देखि ३५", "उचाई": "5 ft 6"}, "Place": {"प्रदेश": "कोशी", "जिल्ला": "Sunsari"}})
    d = spark.createDataFrame([page], "record_id string, name string, sections map<string, map<string, string>>")
    r = tables.import_details(d, "AM").first()
    assert (r["name"], r["sex"], r["age_min"], r["age_max"], r["height_cm"], r["location"], r["district"]) == ("Some Name", "male", 30.0, 35.0, 167.6, "कोशी Sunsari", "Sunsari")
    assert tables.import_details(d, "PM").first()["name"] is None
    assert tuple(tables.import_coverage(tables.import_details(d, "AM")).first()) == (1, 0, 1, 1, 0)
    before = tables.import_details(d, "AM")
    assert tuple(tables.backfill_counts(before, before.withColumn("location", F.lit("x"))).first()) == (1, 0)


def test_commands(spark, tmp_path):
    (tmp_path / "am.csv").write_text("record_id,sex,age_min,age_max,height_cm,event_date,location\nA1,male,30,35,170,2026-01-01,Kathmandu\nA2,female,20,25,150,2083-05-12,Sunsari\n")
    (tmp_path / "pm.csv").write_text("record_id,sex,age_min,age_max,height_cm,event_date,location\nP1,male,31,34,171,2026-01-05,Kathmandu\n")
    main(["compare", f"{tmp_path}/am.csv", f"{tmp_path}/pm.csv", "--out", f"{tmp_path}/matches"])
    rows = spark.read.option("header", True).csv(f"{tmp_path}/matches").orderBy("rank").collect()
    assert [r["am_record_id"] for r in rows] == ["A1", "A2"] and float(rows[0]["final_score"]) == 0.91
    main(["search", f"{tmp_path}/am.csv", f"{tmp_path}/pm.csv", "--out", f"{tmp_path}/found"])
    assert spark.read.parquet(f"{tmp_path}/found").count() == 4
    (tmp_path / "truth.csv").write_text("query_record_id,query_type,correct_candidate_record_id,candidate_type,condition\nP1,pm,A1,am,clean\n")
    main(["evaluate", f"{tmp_path}/am.csv", f"{tmp_path}/pm.csv", "--truth", f"{tmp_path}/truth.csv", "--out", f"{tmp_path}/report"])
    assert '"recall_1": 1.0' in (tmp_path / "report.json").read_text()
    main(["normalize-dates", f"{tmp_path}/am.csv", "--out", f"{tmp_path}/dated"])
    assert {r["calendar_type"] for r in spark.read.parquet(f"{tmp_path}/dated").collect()} == {"AD", "BS"}


def test_embeddings_are_built_and_refreshed(spark, tmp_path):
    (tmp_path / "p.csv").write_text("record_id,image_path\nA,a.jpg\nB,b.jpg\nC,\nD,d.jpg\nE,e.jpg\n")
    shots = tmp_path / "shots"
    shots.mkdir()
    for name, body in (("A", b"one"), ("B", b"two"), ("E", b"")):
        (shots / f"{name}.jpg").write_bytes(body)
    run = lambda *more: main(["build-embeddings", f"{tmp_path}/p.csv", str(shots), *more])
    run("--out", f"{tmp_path}/r1")
    first = {r["record_id"]: r for r in spark.read.parquet(f"{tmp_path}/r1/summary").collect()}
    assert {k: r["failure_reason"] for k, r in first.items()} == {"A": None, "B": None, "C": "no_image_path", "D": "image_file_missing", "E": "image_file_missing"}  # the file source lists no empty files
    (shots / "B.jpg").write_bytes(b"changed")
    (shots / "E.jpg").write_bytes(b"three")
    (tmp_path / "p.csv").write_text("record_id,image_path\nB,b.jpg\nE,e.jpg\n")
    run("--cache", f"{tmp_path}/r1", "--out", f"{tmp_path}/r2")
    vectors = lambda k: {r["record_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/{k}/vectors").collect()}
    old, new = vectors("r1"), vectors("r2")
    assert set(new) == {"A", "B", "E"} and new["A"] == old["A"] and new["B"] != old["B"]
    assert {r["record_id"] for r in spark.read.parquet(f"{tmp_path}/r2/summary").collect()} == set("ABCDE")
    run("--cache", f"{tmp_path}/r2", "--min-face-size", "200", "--force", "--out", f"{tmp_path}/r3")
    assert set(vectors("r3")) == {"A"}  # both records of the run fail the gate now: their vectors are stale
    main(["build-index", f"{tmp_path}/r2/summary", f"{tmp_path}/r2/vectors", "--out", f"{tmp_path}/index"])
    assert spark.read.parquet(f"{tmp_path}/index").count() == 3


def test_names_are_compared_in_their_normal_form(spark):
    place = {"location": "Ｋathmandu", "district": "Kathmandu"}
    fields = "record_id string, pos long, sex string, detected_sex string, age_min double, age_max double, height_cm double, event_day date, location string, province string, district string, municipality string, embedding array<float>"
    row = lambda i, d: spark.createDataFrame([(i, 0, None, None, None, None, None, None, d["location"], None, d.get("district"), None, None)], fields)
    e = Engine(row("A", place), row("P", {"location": "KATHMANDU"}))
    assert e.candidates("pm", "P").first()["location_score"] == 0.8
