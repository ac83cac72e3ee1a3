from collections import defaultdict

from pyspark.sql import functions as F

from linkforge.llm import langid, sharding
from linkforge.llm.queries import held_out

from .cases import frame, real


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~held_out()))
    rows = langid.identify(docs.where(held_out()), model).select("lang", "lang_pred", "rejected", "score").collect()
    known = [r for r in rows if r["lang"] is not None]
    assert sum(r["lang"] == r["lang_pred"] for r in known) / len(known) > 0.97
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)
    far = spark.createDataFrame([(1, "Это предложение написано кириллицей, и модель такого языка не видела"), (2, "漢字仮名交じり文")], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(far, model).collect())


def test_rejection_at_every_length(spark):
    """Texts in letters or letter frequencies that no sample has are rejected, however long; known ones stay, however short."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~held_out()))
    rng, rows = random.Random(3), []
    letters = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3CA)], "han": [chr(0x4E00 + rng.randrange(3000)) for _ in range(500)], "slavic": list("aaaiieeozznrwscytkdpmułjlbgąęóśćżźńh")}
    for name, some in letters.items():
        for n in (10, 100, 1000, 20_000):
            rows += [(f"{name}{n}", " ".join("".join(rng.choice(some) for _ in range(rng.randint(2, 9))) for _ in range(n))) for _ in range(5)]
    far = langid.identify(spark.createDataFrame(rows, "source string, text string"), model).collect()
    assert [r["source"] for r in far if not r["rejected"]] == []
    plain = docs.where(held_out()).where("lang is not null").select("lang", "text")
    words = plain.selectExpr("lang", "array_join(slice(split(text, ' '), 1, 12), ' ') AS text").where("text rlike '[A-Za-z]{3}'")
    short = langid.identify(words, model).collect()
    assert sum(r["rejected"] for r in short) / len(short) < 0.03


def test_columns_of_the_same_names_pass_through(spark):
    docs = frame(spark).selectExpr("*", "doc_id + 0.5 AS score", "'mine' AS lang_pred", "true AS rejected", "1 AS _letters")
    model = langid.fit(frame(spark))
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred_", "score_", "rejected_"]
    kept = langid.known_languages(docs, model)
    assert kept.columns == docs.columns and {(r["score"] - r["doc_id"], r["lang_pred"]) for r in kept.collect()} == {(0.5, "mine")}


def test_sample_is_stable_and_bounded(spark):
    docs = real(spark)
    again = docs.unionByName(docs).repartition(7)  # every doc_id twice: ties
    one, two = langid.fit(again, sample=20), langid.fit(again.repartition(3), sample=20)
    assert one.languages == two.languages and (one.centroids == two.centroids).all() and (one.floors == two.floors).all()


def test_defined_results(spark):
    docs = frame(spark)
    model = langid.fit(docs)
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score", "rejected"] and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.collect()}
    for k in (4, 5, 6, 11):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"]
    assert got[10]["lang_pred"] == "de"
    none = langid.fit(frame(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(frame(spark, []), model).count() == 0


def test_shards_balance_and_slots_have_no_gaps(spark):
    for docs in (frame(spark), real(spark)):
        rows = sharding.shard_rows(docs).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert len(rows) == docs.count() and set(by) <= set(range(24))
        sizes = [len(by[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard_rows(frame(spark, [])).count() == 0


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 24).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 25).collect()}
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.1


def test_walk_overflows_clockwise():
    runs = sharding.walk({0: 10}, [(1, 0), (5, 1), (9, 0), (12, 2)], 3)
    assert [(c, lo, n, s) for c, lo, n, s, _ in runs] == [(0, 0, 4, 0), (0, 4, 3, 1), (0, 7, 3, 2)]


def test_no_language_is_lost_without_ids(spark):
    """Four copies of every document, without an id or with one alone: each language is learned, and its texts are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.crossJoin(spark.range(4).select(F.col("id").alias("copy")))
    for some in (docs.withColumn("doc_id", F.lit(None).cast("long")), docs.withColumn("doc_id", F.lit(7).cast("long"))):
        assert set(langid.fit(some).languages) == {"de", "en", "es", "fr"}
    one = docs.where("lang = 'en'").limit(1).drop("copy").crossJoin(spark.range(3000)).unionByName(docs.where("lang = 'de'").drop("copy").withColumn("id", F.lit(0).cast("long")))
    assert set(langid.fit(one).languages) == {"de", "en"}
