"""Operators without SQL against versions that go document by document and byte by byte."""

import math
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import xxhash

from linkforge.llm import langid, quality, sharding

from .cases import frame, real

WORD = rb"[^\x20\x09-\x0D]+"


def lowered(raw: bytes) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)


# ------------------------------------------------------------------------ sharding


def chained(*parts) -> int:
    """Hash of several values, each seeded by the one before; null leaves the seed."""
    seed = 42
    for x in parts:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed)
    return seed


def walked(rows, shards, virtual):
    """Row by row: each goes to the node after its cell, and on while that node's shard is full."""
    nodes = sorted((chained("node", s, v) % sharding.CELLS, s) for s in range(shards) for v in range(virtual))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    null_first = lambda x: (x is not None, x or 0)
    keyed = []
    for d, text in rows:
        raw = None if text is None else text.encode()
        h = chained("key", d)
        signed = h - (1 << 64) if h >> 63 else h
        keyed.append((h >> 48, signed, null_first(d), len(raw or b"") + 8, null_first(None if raw is None else zlib.crc32(raw))))
    waiting, slots, out = [[] for _ in nodes], [0] * shards, []
    for row in sorted(keyed):
        waiting[bisect_left([c for c, _ in nodes], row[0]) % len(nodes)].append(row)
    while any(waiting):
        after = [[] for _ in nodes]
        for k, some in enumerate(waiting):
            for row in some:
                s = nodes[k][1]
                if room[s]:
                    out.append((row[2][1] if row[2][0] else None, row[3], row[4][1] if row[4][0] else None, s, slots[s]))
                    slots[s] += 1
                    room[s] -= 1
                else:
                    after[(k + 1) % len(nodes)].append(row)
        waiting = after
    return sorted(out, key=str)


@pytest.mark.parametrize("shards,virtual", [(24, 64), (5, 3)])
def test_shards_equal_a_walk_of_every_row(spark, shards, virtual):
    lone = [(None, "a"), (None, None), (None, "b"), (7, "x"), (7, "x"), (7, "y")]
    for docs in (frame(spark), real(spark), spark.createDataFrame(lone, "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = sharding.shard_rows(docs, shards, virtual).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(tuple, got), key=str) == walked(rows, shards, virtual)


# ---------------------------------------------------------------------- language ID


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of bytes, one gram at a time."""
    raw = bytearray(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in text.encode())
    raw = bytearray(b + 32 if 65 <= b <= 90 else b for b in raw)
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            raw[i] += 0x20
    out = np.zeros(langid.DIMENSIONS)
    for size in (1, 2, 3):
        for i in range(len(raw) - size + 1):
            gram = int.from_bytes(raw[i : i + size], "big")
            mixed = (gram * 2654435761 + size * 0x5BD1E995) * 0x9E3779B1 % (1 << 32)
            out[mixed >> 32 - langid.BITS] += 1
    return out


def normal(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.array([(1 + math.log(n)) * w if n else 0.0 for n, w in zip(x, idf)])
    size = math.sqrt(sum(v * v))
    return v / size if size else v


def clustered(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Spherical k-means: the mean first, then each time the row farthest from all, then twelve rounds."""
    unit = lambda x: x / math.sqrt(float(x @ x))
    c = [unit(sum(rows))]
    while len(c) < min(langid.CENTROIDS, len(rows)):
        c.append(min(rows, key=lambda r: max(float(r @ x) for x in c)))
    for _ in range(12):
        own = [max(range(len(c)), key=lambda j: float(r @ c[j])) for r in rows]
        c = [unit(sum(r for r, o in zip(rows, own) if o == j)) if j in own else c[j] for j in range(len(c))]
    return c


def low_floor(rows, sizes, c, length) -> float:
    near = [max(float(r @ x) for x in c) for r in rows]
    away = [abs(s - length) for s in sizes]
    reach = max(1, sorted(away)[min(len(away), langid.ROWS) - 1])
    some = sorted(n for n, a in zip(near, away) if a <= reach)
    at = langid.LOW * (len(some) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(some) - 1)
    return langid.FAR * (some[lo] + (some[hi] - some[lo]) * (at - lo))


def test_languages_equal_a_recount(spark):
    """idf, centroids, floors and every prediction; the sample holds all rows here."""
    docs = real(spark)
    model = langid.fit(docs)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    learned: dict[str, list[np.ndarray]] = {}
    for lang, text in rows:
        if lang is not None and text is not None and any(ch.isalpha() for ch in text):
            learned.setdefault(lang, []).append(gram_counts(text))
    assert all(len(x) <= langid.SAMPLE for x in learned.values())
    every = [x for some in learned.values() for x in some]
    idf = np.log((1 + len(every)) / (1 + sum((x > 0).astype(float) for x in every))) + 1
    np.testing.assert_allclose(model.idf, idf, rtol=1e-5)
    names, c, low = [], [], []
    for lang in sorted(learned):
        some = sorted(learned[lang], key=lambda x: x.astype(np.float32).tobytes())
        vectors = [normal(x, idf) for x in some]
        own = clustered(vectors)
        sizes = [int(math.log2(max(1, x.sum()))) for x in some]
        floors = [low_floor(vectors, sizes, own, k) for k in range(langid.LENGTHS)]
        names += [lang] * len(own)
        c += own
        low += [floors] * len(own)
    assert model.languages == names
    np.testing.assert_allclose(model.centroids, np.array(c), atol=2e-4)
    np.testing.assert_allclose(model.floors, np.array(low), atol=2e-4)
    for r in langid.identify(docs, model).collect():
        text = r["text"]
        if text is None or not any(ch.isalpha() for ch in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        x = gram_counts(text)
        near = [float(normal(x, idf) @ y) for y in c]
        best = max(near)
        assert abs(r["score"] - best) < 1e-3 and best - max(n for n, k in zip(near, names) if k == r["lang_pred"]) < 1e-3
        floor = low[near.index(best)][min(int(math.log2(max(1, x.sum()))), langid.LENGTHS - 1)]
        assert abs(best - floor) < 1e-3 or r["rejected"] == (best < floor)


# -------------------------------------------------------------------------- quality

JUNK, STOPS = b"#$%&*@^~=<>{}[]\\", b".,;:?'\"()-"


def judged(text: str | None) -> str:
    """The ten votes on a text, each measure counted by itself."""
    raw = (text or "").encode()
    words = [lowered(w) for w in re.findall(WORD, raw)]
    n = max(1, len(words))
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    ink = max(1, sum(b not in b" \t\n\v\f\r" for b in raw))
    share = lambda some: sum(b in some for b in raw)
    known = {w.encode() for w in quality.FUNCTION_WORDS}
    lines, again = Counter(), 0
    for line in re.findall(rb"[^\n]*\n|[^\n]+", raw):
        again += len(line) * (len(line) > 20 and lines[line] > 0)
        lines[line] += 1
    value = {
        "words": len(words), "letters": letters / ink, "capitals": sum(65 <= b <= 90 for b in raw) / max(1, letters), "junk": share(JUNK) / ink, "bars": share(b"|") / n, "shouts": share(b"!") / n,
        "digits": share(b"0123456789") / ink, "known": sum(lowered(w) in known for w in words) / n, "repeated": again / max(1, len(raw)), "distinct": len(set(words)) / n,
    }
    out = ""
    for name, under, over, lo, hi in quality.LABELLERS:
        x = value[name]
        out += "0" if x < under or x > over else "1" if lo <= x <= hi else "2"
    return out


def labelled(votes: list[str], rounds: int = 60) -> list[float]:
    """Posteriors of `good`: expectation and maximisation over single documents."""
    post = [(0.5 + v.count("1")) / (1 + len(v) - v.count("2")) for v in votes]
    for _ in range(rounds):
        weight = (sum(1 - p for p in post), sum(post))
        prior = [max(1e-3, min(1, w / sum(weight))) for w in weight]
        chance = []
        for j in range(len(votes[0])):
            for good in (0, 1):
                n = {k: 0.5 for k in "012"}
                for v, p in zip(votes, post):
                    n[v[j]] += p if good else 1 - p
                chance.append({k: x / sum(n.values()) for k, x in n.items()})
        post = []
        for v in votes:
            bad, good = (math.log(prior[g]) + sum(math.log(chance[2 * j + g][v[j]]) for j in range(len(v))) for g in (0, 1))
            post.append(1 / (1 + math.exp(max(-60, min(60, bad - good)))))
    return post


def test_votes_and_posteriors_equal_a_recount(spark):
    for docs in (frame(spark), real(spark)):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        got = [r.asDict() | {"text": texts[r["doc_id"]]} for r in quality.classify(docs).collect()]
        assert len(got) == docs.count()
        votes = [judged(r["text"]) for r in got]
        assert votes == [r["votes"] for r in got]
        for r, p in zip(got, labelled(votes)):
            assert abs(r["weak_label"] - p) < 1e-6


def test_votes_on_empty_texts_do_not_depend_on_their_neighbours(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "some words of a text")], "doc_id long, text string")
    runs = [{r["doc_id"]: r["votes"] for r in quality.classify(docs.repartition(n, "doc_id")).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] == {i: judged(t) for i, t in docs.collect()}
