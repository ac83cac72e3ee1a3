import hashlib
import random
import re
import zlib

import numpy as np

from linkforge.llm import runs

from .cases import frame, real


def brute_runs(w, least=runs.LEAST):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(d, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str("" if d is None else d).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (d, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_all_runs_of_random_words():
    """Small alphabets, planted periods, every least length; several documents in one go."""
    rng, total = random.Random(3), 0
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 50]), rng.randint(0, 90)
            w = [str(rng.randrange(k)) for _ in range(n)]
            if rng.random() < 0.6 and n > 5:
                p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
                w = w[:a] + [w[min(n - 1, a + i % p)] for i in range(n - a)] + w[: rng.randint(0, 20)]
            docs.append(w)
        least = rng.choice([12, 12, 2, 3, 5, 8, 20])
        for w, (_, got) in zip(docs, runs.document_runs([" ".join(w).encode() for w in docs], [None] * len(docs), least)):
            expected = brute_runs(w, least)
            total += len(expected)
            assert list(map(tuple, got.tolist())) == expected
    assert total > 1000


def test_report_equals_brute_force(spark):
    short = real(spark).where("length(text) < 4000")
    extra = [(10, "a b " * 40), (20, "x " * 12), (30, "x " * 11), (None, "one two three " * 9), (70, None), (90, " \t\n\x0b\x0c\r "), (17, "p q r s " * 8), (17, "p q r s " * 8), (40, "    " * 20)]
    extra += [(d, " ".join(f"w{i}" for i in range(d % 97))) for d in range(1000, 1100)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in short.collect()] + extra, "doc_id long, text string")
    got = sorted(map(tuple, runs.run_report(docs, echo=True).collect()), key=str)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_long_periodic_document():
    """60,000 words that repeat five and a half times, with a fault near the end."""
    rng = random.Random(8)
    part = [b"w%d" % rng.randrange(3000) for _ in range(10_000)]
    w = (part * 6)[:55_000] + [b"other"] + (part * 6)[55_000:59_999]
    ((_, got),) = runs.document_runs([b" ".join(w)], [None])
    assert list(map(tuple, got.tolist())) == [(0, 55_000, 10_000)]


def test_without_runs(spark):
    docs = spark.createDataFrame([(1, "so  it goes " * 9 + "end"), (2, "no\n\nrun  here"), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in runs.without_runs(docs).collect()} == {1: "so it goes end", 2: "no\n\nrun  here", 3: None, 4: ""}
    assert len(runs.collapsed([b"a"] * 12, np.array([[0, 12, 1]]))) == 1


def test_hostile_rows(spark):
    rows = runs.run_report(frame(spark), echo=True).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in frame(spark).collect())
    assert runs.run_report(frame(spark, [])).count() == 0 == runs.without_runs(frame(spark, [])).count()
