import re
import zlib
from collections import Counter

from linkforge.llm import spelling

from .cases import frame, real


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slips=None):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, near = {}, {}
    for w in n:
        others = [v for v in n if one_apart(v, w)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], near[w], n.get(form.get(w))) for w in n), key=str)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in real(spark).select("doc_id", "text").collect()]
    got = result(spelling.spelling_variants(real(spark), slips=19))
    assert got == brute(rows, 19) and sum(r[1] is not None for r in got) > 10
    assert result(spelling.spelling_variants(real(spark))) == brute(rows)


def test_hostile_rows(spark):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(spelling.spelling_variants(docs, slips=3)) == brute(rows, 3)
    rows = [(None, "straße Straße STRAßE straße strasse " * 2), (None, None), (1, "aaaaaab " * 6 + "aaaaaaa " * 40 + "aaaaaabb " * 5), (1, "aaaaaab " * 6), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for slips in (None, 2, 5):
        assert result(spelling.spelling_variants(docs, slips=slips)) == brute(rows, slips)
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_forms_are_followed_to_the_last_root(spark):
    """A chain of eight words, each commoner than the one before, and ties that the code points decide."""
    chain = [("abcdefgh"[:i] + "z" * (8 - i), 5 ** (i + 1)) for i in range(9)]
    ties = [("ébcdeg", 50), ("ebcdeg", 50), ("xbcdeg", 10), ("abcdegh", 9)]
    words = spark.createDataFrame(chain + ties, "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words).collect()}
    assert {got[w]["root"] for w, _ in chain} == {"abcdefgh"} and got["zzzzzzzz"]["form"] == "azzzzzzz"
    assert got["xbcdeg"]["form"] == "ebcdeg" and got["xbcdeg"]["n_near"] == 2 and got["ébcdeg"]["form"] is None and got["ébcdeg"]["n_near"] == 2
    assert (got["abcdegh"]["n_near"], got["abcdegh"]["form"]) == (1, "abcdefgh")


def test_each_near_pair_is_proposed_once(spark):
    words = ["aabbab", "aabbabb", "aabbbab", "ababab", "bababa", "aababab", "abbabab", "aaaaaa", "aaaaab", "aaaaba", "aaaaaaa"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((r["word"], r["other"]) for r in spelling.near_words(df).collect())
    assert got == sorted((a, b) for a in words for b in words if one_apart(a, b))
