"""Golden values of the shared synthetic data set, and a row-wise scorer against the plans."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.functions import dates, quality, scoring, text, vector
from linkforge.functions.location import with_profile
from linkforge.operators import enrich, evaluate, pairs, review
from linkforge.schema import PERSON, conform

FIELDS = "record_id string, pos long, sex string, detected_sex string, age_min double, age_max double, height_cm double, event_day date, location string, province string, district string, municipality string, embedding array<float>"


def unit(seed):
    v = np.random.default_rng(seed).normal(size=8).astype(np.float32)
    return (v / np.linalg.norm(v)).astype(float).tolist()


D = datetime.date
#: 2082-05-12 and -20 BS lie eight days apart in one month.
AM = [
    ("AM1", 0, "male", "male", 30.0, 35.0, 170.0, D(2025, 8, 28), "Bagmati Kathmandu", "Bagmati", "Kathmandu", "Kathmandu Metro", unit(1)),
    ("AM2", 1, "female", "female", 20.0, 25.0, 160.0, D(2026, 1, 5), "Koshi Sunsari", "Koshi", "Sunsari", None, unit(2)),
    ("AM3", 2, "male", None, 40.0, 45.0, 175.0, None, None, None, None, None, None),
]
PM = [
    ("PM1", 0, "male", "male", 28.0, 33.0, 171.0, D(2025, 9, 5), "Kathmandu Metro", None, None, None, unit(3)),
    ("PM2", 1, "female", None, 55.0, 60.0, 155.0, D(2026, 1, 8), "Sunsari", None, None, None, None),
    ("PM3", 2, "other", None, None, None, None, None, None, None, None, None, None),
]
GOLD = {
    ("AM1", "PM1"): (1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("AM1", "PM2"): (0.0, 0.1, 0.4, 0.2, 0.35, 0.165), ("AM1", "PM3"): (0.0, 0.5, 0.5, 0.5, 0.5, 0.35),
    ("AM2", "PM1"): (0.0, 0.7, 0.4, 0.2, 0.35, 0.315), ("AM2", "PM2"): (1.0, 0.1, 1.0, 1.0, 0.8, 0.735), ("AM2", "PM3"): (0.0, 0.5, 0.5, 0.5, 0.5, 0.35),
    ("AM3", "PM1"): (1.0, 0.4, 1.0, 0.5, 0.5, 0.675), ("AM3", "PM2"): (0.0, 0.4, 0.4, 0.5, 0.5, 0.315), ("AM3", "PM3"): (0.0, 0.5, 0.5, 0.5, 0.5, 0.35),
}


@pytest.fixture(scope="module")
def both(spark):
    """In the ASCII form, so that plans show the pair path alone: the Unicode form is made once a record, before any pair."""
    return tuple(pairs.prepare(spark.createDataFrame(x, FIELDS), text.normalize_ascii) for x in (AM, PM))


def test_golden_scores(both):
    a, p = (pairs.prefixed(x, n) for x, n in zip(both, ("am_", "pm_")))
    rows = pairs.scored(pairs.cross(a, p)).collect()
    assert len(rows) == 9
    for r in rows:
        assert (*[r[c] for c in scoring.COMPONENTS], r["metadata_score"]) == GOLD[r["am_record_id"], r["pm_record_id"]]
    face = {(r["am_record_id"], r["pm_record_id"]): (round(r["similarity"], 6), r["face_score"], r["final_score"]) for r in rows if r["similarity"] is not None}
    assert face == {("AM1", "PM1"): (-0.008927, 0.4955, 0.6973), ("AM2", "PM1"): (0.174249, 0.5871, 0.4783)}


def test_golden_rankings(both):
    rank = lambda side: {k: [r["candidate_record_id"] for r in sorted(v, key=lambda r: r["rank"])] for k, v in by(pairs.search(*both, side)).items()}

    def by(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["query_record_id"], []).append(r)
        return out

    assert rank("am") == {"AM1": ["PM1"], "AM2": ["PM1"], "AM3": ["PM1", "PM3", "PM2"]}
    assert rank("pm") == {"PM1": ["AM1", "AM2"], "PM2": ["AM2", "AM3", "AM1"], "PM3": ["AM1", "AM2", "AM3"]}
    source = {r["query_record_id"]: r["candidate_source"] for r in pairs.search(*both, "pm").collect()}
    assert source == {"PM1": "face+metadata", "PM2": "metadata_only", "PM3": "metadata_only"}


def test_evaluation_and_ablation_denominators(spark, both):
    truth = spark.createDataFrame([("AM1", "am", "PM1", "clean"), ("PM1", "pm", "AM1", "clean"), ("AM3", "am", "PM2", "blur")], "query_record_id string, query_type string, correct_candidate_record_id string, condition string")
    found = pairs.search(*both, "am").unionByName(pairs.search(*both, "pm"))
    r = evaluate.metrics(evaluate.truth_ranks(truth, found)).first()
    assert r["recall_1"] == pytest.approx(2 / 3) and r["recall_5"] == r["recall_20"] == 1.0 and r["mrr"] == pytest.approx(0.7778, abs=1e-4)
    assert evaluate.metrics(evaluate.truth_ranks(truth.limit(0), found)).first()["mrr"] == 0.0


def test_no_forbidden_names_and_a_bounded_plan(both):
    df = pairs.search(*both, "pm")
    assert not {"confidence", "identity_probability", "match_probability", "identity"} & set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "BroadcastNestedLoopJoin" in plan


def test_large_galleries_are_not_broadcast(both):
    a, p = (pairs.prefixed(x, n) for x, n in zip(both, ("am_", "pm_")))
    df = pairs.cross(a, p, most=2)
    assert df.count() == 9 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_both_directions_equal_one_each(both):
    df = pairs.search(*both, "both")
    one = sorted(map(str, pairs.search(*both, "am").unionByName(pairs.search(*both, "pm")).collect()))
    assert sorted(map(str, df.collect())) == one
    near = pairs.search(*both, "both", first_stage=1)
    assert near.where("candidate_source = 'face+metadata'").groupBy("query_type", "query_record_id").count().where("count > 1").isEmpty()


def test_broadcasts_are_bounded_by_bytes(spark):
    long = spark.createDataFrame([(1, "x" * 10_000, [0.5] * 1000)], "pos long, name string, embedding array<double>")
    assert 15_000 < pairs.bytes_of(long) < 25_000 and pairs.bytes_of(long.limit(0)) == 0


def test_transient_neutral_query(spark, both):
    one = pairs.prepare(spark.createDataFrame([("Q", 0) + (None,) * 11], FIELDS))
    rows = pairs.transient(one, both[0], "am", 500).collect()
    assert [r["final_score"] for r in rows] == [0.5] * 3 and all(r["candidate_source"] == "metadata_only" for r in rows)


def row_score(a, p):
    """SCO-02 to -07 in plain Python."""
    band = lambda d: 0.5 if d is None else next((s for m, s in ((5, 1.0), (10, 0.7), (20, 0.4), (999, 0.1)) if d <= m), 0.1)
    signals = [x == y for x, y in ((a["sex"], p["sex"]), (a["detected_sex"], p["detected_sex"])) if x and y]
    sex = sum(signals) / len(signals) if signals else 0.5
    mid = lambda r: None if r["age_min"] is None else (r["age_min"] + (r["age_max"] or r["age_min"])) / 2
    age = band(None if mid(a) is None or mid(p) is None else abs(mid(a) - mid(p)))
    height = band(None if a["height_cm"] is None or p["height_cm"] is None else abs(a["height_cm"] - p["height_cm"]))
    gap = None if a["event_day"] is None or p["event_day"] is None else (p["event_day"] - a["event_day"]).days
    date = 0.5 if gap is None else 0.2 if gap < 0 else 1.0 if gap <= 10 else 0.7 if gap <= 30 else 0.4 if gap <= 90 else 0.2
    return sex, age, height, date


def test_random_rows_at_band_edges(spark):
    rng = random.Random(9)
    some = lambda *x: rng.choice([None, *x])

    def record(name, k):
        day = rng.choice([None, 0, 1, 10, 11, 30, 31, 90, 91])
        return (
            f"{name}{k}", k, some("male", "female"), some("male", "female"), some(30.0, 34.99, 35.0, 35.01, 40.0), some(0.0, 40.0, 50.02), some(150.0, 154.99, 155.0, 155.01, 170.0, 2000.0),
            None if day is None else D(2024, 1, 1) + datetime.timedelta(day), None, None, None, None, None,
        )

    left, right = [record("A", k) for k in range(60)], [record("P", k) for k in range(60)]
    names = [x.split()[0] for x in FIELDS.split(", ")]
    a = pairs.prefixed(pairs.prepare(spark.createDataFrame(left, FIELDS)), "am_")
    p = pairs.prefixed(pairs.prepare(spark.createDataFrame(right, FIELDS)), "pm_")
    by = {r[0]: dict(zip(names, r)) for r in left + right}
    for r in pairs.scored(pairs.cross(a, p), face=False).collect():
        assert tuple(r[f"{c}_score"] for c in ("sex", "age", "height", "date")) == row_score(by[r["am_record_id"]], by[r["pm_record_id"]])


def test_dates(spark):
    raw = ["2083-05-12", "२०८३-०५-१२", "2083-05-12 A.D", "2026-02-30", "seen 2026/1/5 late", "", None, "2095-01-01", "2082-04-17", "bs 2030-1-1"]
    got = dates.normalize_dates(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, event_date string")).orderBy("i").collect()
    assert [(r["calendar_type"], str(r["event_date_normalized"])) for r in got] == [
        ("BS", "2026-08-28"), ("BS", "2026-08-28"), ("AD", "2083-05-12"), ("unknown", "None"), ("AD", "2026-01-05"), ("unknown", "None"), ("unknown", "None"), ("unknown", "None"), ("BS", "2025-08-02"), ("unknown", "None"),
    ]
    stored = spark.createDataFrame([("2024-01-02", "2083-05-12"), ("bad", "2083-05-12")], "event_date_normalized string, event_date string")
    assert [str(r["event_day"]) for r in dates.stored_or_normalized(stored).collect()] == ["2024-01-02", "2026-08-28"]
    assert len(dates.bs_rows()) == 12 * len(dates.BS_MONTHS)


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(text.normalize_text(lit("Kathmandu,  Nepal."))) == "kathmandu nepal" and one(text.normalize_text(lit("Ｓtraße"))) == "strasse"
    heights = {"5 ft 7": 170.2, "५ फिट ६ इन्च": 167.6, "170 cm": 170.0, "१७० से.मि": 170.0, "5.5": 167.6, "165": 165.0, "tall": None, None: None}
    for raw, cm in heights.items():
        assert one(text.height_to_cm(lit(raw).cast("string"))) == cm
    assert one(text.to_float(lit(" 1.5e1 "))) == 15.0 and one(text.to_float(lit("5d"))) is None
    m = one(text.label_values(text.tokens(lit("flood | 12 | नाम :- | Ram | Lal, | उमेर:- | 30 | नाम :- | again"))))
    assert m == {"नाम": "Ram Lal, again", "उमेर": "30"}
    assert one(text.disaster_tag(text.preamble(text.tokens(lit("१२ | flood | नाम :- | x"))))) == "flood"
    assert one(text.list_date(lit("seen २०८२-०५-१२ there"))) == "२०८२-०५-१२"
    assert one(text.list_record_id(lit(3), lit("a_i17.jpg"))) == "PM-LIST-p3-i17"


def test_location_tiers(spark):
    rows = [("कोशी", "बागमती", 0.25), ("a b c", "b c d", 0.75), ("a b", "b d", 0.55), ("a", "z", 0.35), (None, "z", 0.5)]
    from linkforge.functions.location import location_score

    for left, right, score in rows:
        schema = "location string, province string, district string, municipality string"
        a, p = (pairs.prefixed(with_profile(spark.createDataFrame([(x, None, None, None)], schema), text.normalize_text), n) for x, n in ((left, "am_"), (right, "pm_")))
        assert a.crossJoin(p).select(location_score()).first()[0] == score


def test_vectors_quality_and_reviews(spark):
    assert [vector.first_stage_k(*x) for x in (("all", 6000), (50, 1000), (500, 10), ("all", 150_000), (5, 0))] == [6000, 50, 10, 100_000, 0]
    gate = lambda w, h, s, b=None, l=None, **k: spark.range(1).select(quality.assessment(*[F.lit(x).cast("double") for x in (w, h, s, b)], F.lit(l).cast("boolean"), **k)).first()[0]  # noqa: E731, E741
    assert gate(30, 90, 0.9)["quality_reasons"] == ["face_too_small"] and gate(90, 90, None)["quality_reasons"] == ["low_detector_confidence"]
    assert gate(90, 90, 0.9)["quality_band"] == "good" and gate(50, 90, 0.9)["quality_band"] == "moderate" and gate(50, 90, 0.6, 1, False, min_blur=5.0)["quality_reasons"] == ["blurry", "borderline_detector_confidence", "small_face_margin", "no_landmarks"]
    one = lambda x: spark.range(1).select(review.canonical_decision(F.lit(x).cast("string"))).first()[0]
    assert [one(x) for x in ("Not a likely candidate", "insufficient-evidence", "nope", None)] == ["rejected", "inconclusive", None, None]


def test_cache_refresh(spark):
    m = spark.createDataFrame([("a", "1", "v"), ("b", "1", "v"), ("c", "2", "v"), ("d", "1", "w"), ("e", "1", "v")], "record_id string, image_sha256 string, model_version string")
    c = spark.createDataFrame([("a", "1", "v", True, True), ("b", "1", "v", False, False), ("c", "1", "v", True, True), ("d", "1", "v", True, True), ("e", "1", "v", True, False)], "record_id string, image_sha256 string, model_version string, usable boolean, vector_exists boolean")
    assert sorted(r[0] for r in enrich.cache_hits(m, c).collect()) == ["a", "b"] and sorted(r[0] for r in enrich.cache_misses(m, c).collect()) == ["c", "d", "e"]
    images = spark.createDataFrame([("a", b"x"), ("b", b"x"), ("c", None)], "record_id string, content binary")
    v = {r[0]: r[1] for r in enrich.encode(images, enrich.digest_encoder).collect()}
    assert v["a"] == v["b"] != v["c"] and abs(sum(x * x for x in v["a"]) - 1) < 1e-5


def test_absent_columns_are_null(spark):
    got = conform(spark.createDataFrame([("x", "12"), ("y", "abc")], "record_id string, age_min string"), PERSON)
    assert got.columns == PERSON.names and [r["age_min"] for r in got.orderBy("record_id").collect()] == [12.0, None]


def test_labels_that_meet_after_trimming(spark):
    s = spark.sql("SELECT map('T', map(' a', '', 'a ', 'v'), 'U', map('a', 'w')) AS s UNION ALL SELECT map('T', map('a', 'x', ' a', ''), 'U', map('a', 'w'))")
    assert [r[0] for r in s.select(text.find_first(F.col("s"), ["a"], strip=True)).collect()] == ["v", "w"]
    assert spark.range(1).select(text.image_url(F.lit("")), text.image_url(F.lit(text.IMAGE_ROOT + "x.jpg"))).first()[:] == (None, "/images/x.jpg")


def test_sections_end_with_their_card():
    from linkforge.sources.tables import page_sections

    card = "<div class='card-body'><h4 class='card-title'> T </h4><p><strong>A :</strong> .. <div><span>no</span></div><span>x<br>y</span></p><p><strong>B:</strong> rest</p></div>"
    name, found = page_sections(f"<h3>N<script>var x</script></h3>{card}<p><strong>OUT:</strong> no</p><section><b class='card-title'>U</b><strong></strong><strong>C</strong>: 1 <i>2</i></section>")
    assert name == "N" and found["T"] == {"A": "xy", "B": "rest"} and found["U"].keys() == {"C"}
    assert page_sections("") == ("", {}) and page_sections("<p><strong>x</strong>")[1] == {}


def test_has_face_is_the_usable_flag(spark, both):
    from linkforge.service import Engine

    am = both[0].withColumn("usable", F.when(F.col("pos") == 0, True))
    assert [r["has_face"] for r in Engine(am, both[1]).list_records("am")[1].collect()] == [am.orderBy("pos").first()["usable"] or False] + [False] * 2
