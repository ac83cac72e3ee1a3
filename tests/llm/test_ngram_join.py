import re

from linkforge.llm import ngram_join
from linkforge.llm.common import components

from .cases import frame, real


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def test_components_equal_all_pairs(spark):
    for docs in (frame(spark), real(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_chains_of_near_copies(spark):
    """Each copy is linked to its neighbours alone, so components need the second pass."""
    words = [f"w{i}" for i in range(400)]
    rows = [(500 - k, " ".join(words[3 * k : 3 * k + 100])) for k in range(60)]
    rows += [(k, " ".join(words[:40] + [f"own{k}x{i}" for i in range(60)])) for k in range(40)]
    rows += [(1000 + k, " ".join(words[200:300] + [f"z{k}"])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_small_partitions_that_start_with_the_same_text(spark):
    """Each partition holds a copy of one text and a text of its own; every second of those repeats the one before but for a word."""
    copy, rows = " ".join(f"c{i}" for i in range(30)), []
    for k in range(40):
        own = [f"t{k // 2}x{i}" for i in range(40 + k // 2)] + [f"last{k}"]
        rows += [(2 * k, copy), (2 * k + 1, " ".join(own))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 40), "doc_id long, text string")
    assert docs.rdd.glom().map(lambda part: [r["text"] == copy for r in part]).collect() == [[True, False]] * 40
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words cancel in every polynomial modulo 2 ** 64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (4, "x " + a), (5, "x " + b), (6, "c" * (3 << 20)), (7, "c" * (3 << 20) + "d")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_copies_of_one_text_over_many_files(spark, tmp_path):
    docs = real(spark).select("doc_id", "text").where("text is not null")
    hot = docs.where("length(text) > 500").orderBy("doc_id").limit(1).select("text").first()[0]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6 + i, hot) for i in range(300)]
    spark.createDataFrame(rows, docs.schema).repartition(64).write.parquet(f"{tmp_path}/d")
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.read.parquet(f"{tmp_path}/d")).collect()))
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a"), (1, text + " z", "b"), (2, text, "c"), (None, text, "d"), (None, "lone", "e"), (3, None, "f")], "doc_id long, text string, n string")
    out = ngram_join.one_of_each(docs).collect()
    assert [r["doc_id"] for r in out].count(1) == 1 and sorted(r["n"] for r in out if r["doc_id"] != 1) == ["d", "e", "f"]
    again = ngram_join.one_of_each(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_one_of_each_keeps_rows_whole(spark):
    docs = frame(spark)
    out = ngram_join.one_of_each(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert {4, 5, 6, 7, 9, 10} <= set(ids) and not {2, 3, 8} & set(ids) and ids.count(17) == 1


def test_empty_table_and_components(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99)] + [(200, 200 + i) for i in range(1, 30)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert {got[i] for i in range(51)} == {0} and got[100] == 99 == got[99] and {got[200 + i] for i in range(30)} == {200}
