import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from linkforge.llm import exact, queries

from .cases import SF, frame, real


def brute(rows):
    """Every row's outcome, one of the rows that agree in id and text standing for the others' places."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in sorted(ids, key=lambda d: (d is not None, d or 0), reverse=True):
            out.append((d, keep, len(ids), d == keep and left == 1, hashlib.sha256(t.encode()).hexdigest()))
            left -= d == keep
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.drop("n_chunks").collect()], key=str)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_equals_brute_force(spark):
    for docs in (frame(spark), real(spark)):
        assert result(exact.exact_duplicates(docs)) == brute(pairs(docs))


def test_chunks_spell_the_text_and_follow_its_content(spark):
    docs = frame(spark).unionByName(real(spark).select("doc_id", "text"), allowMissingColumns=True).select("text").where("text is not null")
    cut_ = docs.select("text", exact.chunks(F.col("text")).alias("c"))
    assert cut_.where(F.array_join("c", "") != F.col("text")).count() == 0
    assert cut_.where(F.exists("c", lambda c: (F.char_length(c) > exact.LONGEST) | (c == ""))).count() == 0
    long_ = real(spark).where("length(text) > 5000").select("text").first()[0]
    a, b = ({c for c in r["c"]} for r in spark.createDataFrame([(long_,), ("A word put in front. " + long_,)], "text string").select(exact.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 6 and len(a & b) >= len(a) - 2
    assert sum(map(len, a)) / len(a) < 1500


def test_digests_that_clash_are_told_apart_by_content(spark):
    """Four bits of a digest: contents clash all the time, equality still holds."""
    weak = lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 2))
    rows = pairs(frame(spark)) + [(1000 + i, f"text {i % 40}") for i in range(120)] + [(1000, "text 1"), (None, "text 1"), (None, "text 2"), (None, "text 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.clashes(docs, digest=weak).count() > 50
    assert result(exact.exact_duplicates(docs, digest=weak)) == brute(rows) == result(exact.exact_duplicates(docs))


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (None, ""), (3, "b"), (3, "b"), (3, "b"), (2, "b"), (None, "b"), (5, None), (6, "c" * 9000), (7, "c" * 9000), (7, "c" * 9001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(exact.exact_duplicates(docs))
    assert got == brute(rows) and sum(r[3] for r in got) == 5
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_more_equal_rows_than_one_array_holds(spark):
    n = 2 * exact.BLOCK + 5
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = exact.exact_duplicates(docs).groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(n, False, n - 1), (n, True, 1)]


def test_invalid_utf8_stays_apart(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(x'61FF' AS STRING) AS text UNION ALL SELECT 2L, CAST(x'61FE' AS STRING) UNION ALL SELECT 3L, CAST(x'61FF' AS STRING)")
    assert [(r["doc_id"], r["keep_id"]) for r in exact.exact_duplicates(docs).orderBy("doc_id").collect()] == [(1, 3), (2, 2), (3, 3)]


def test_without_copies_keeps_rows_whole(spark):
    docs = frame(spark)
    out = exact.without_copies(docs)
    assert out.columns == docs.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == sorted(d for d, _, _, k, _ in brute(pairs(docs)) if k) and kept.count(17) == 1 and 5 in kept and 4 not in kept
    rows = [(1, "t", "p"), (1, "t", "q"), (None, "u", "r"), (None, "u", "s"), (0, "t", "x")]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(tuple, exact.without_copies(d).collect()), key=str) for d in (some, some.repartition(4)))
    assert once == again and len(once) == 2


def test_no_python_in_the_plan(spark):
    plan = queries.op13_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
