import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkforge.llm import chat, fingerprints

from .cases import frame, real


def plain_print(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, body = [], []
    for s in text.split("\n\n"):
        nodes, ends = [], []
        for p in s.split("\n"):
            own = [sha(c) for c in re.split(r"(?<=[!-/:-@\[-`{-~][ \t\n\x0b\f\r])", p)]
            ends.append(".".join(x[:10] for x in own))
            nodes.append(sha("".join(own)))
        sections.append(sha("".join(nodes)))
        body.append(sections[-1][:16] + "=" + ",".join(ends))
    return sha("".join(sections)) + ":" + "/".join(body)


def dice(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = (set(re.split("[./,]", re.sub("[0-9a-f]+=", "", p.split(":")[1]))) for p in (a, b))
    return min(2 * len(x & y) / (len(x) + len(y)), 0.999999)


def differing(x, y):
    if len(x) == len(y):
        return [(i, 1, 1) for i in range(len(x)) if x[i] != y[i]]
    n, i, j = min(len(x), len(y)), 0, 0
    while i < n and x[i] == y[i]:
        i += 1
    while j < n - i and x[-1 - j] == y[-1 - j]:
        j += 1
    return [(i, len(x) - i - j, len(y) - i - j)]


def located(a, b):
    x, y = (f.split(":")[1].split("/") for f in (a, b))
    out = []
    for i, n, m in differing([s.split("=")[0] for s in x], [s.split("=")[0] for s in y]):
        if (n, m) != (1, 1):
            out.append(f"{i}:{n}:{m}")
            continue
        p, q = (s[i].split("=")[1].split(",") for s in (x, y))
        for j, n, m in differing(p, q):
            if (n, m) != (1, 1):
                out.append(f"{i}.{j}:{n}:{m}")
            else:
                out += [f"{i}.{j}.{k}:{n}:{m}" for k, n, m in differing(p[j].split("."), q[j].split("."))]
    return " ".join(out)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1].encode()))
    out = []
    for k, (d, t) in enumerate(rows):
        n, follow = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + follow[: n // 2]
        a, b, c = plain_print(t), plain_print(edited), plain_print(follow)
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), a, b, dice(a, b), dice(a, c), located(a, b)))
    return sorted(out, key=str)


def test_report_equals_brute_force(spark, monkeypatch):
    for rows_of_range in (1024, 7):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_of_range)
        for docs in (frame(spark), real(spark)):
            want = brute([(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()])
            got = sorted(map(tuple, fingerprints.fingerprint_report(docs).collect()), key=str)
            assert [(*g[:5], g[7]) for g in got] == [(*w[:5], w[7]) for w in want]
            assert all(abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9 for g, w in zip(got, want))


def test_edits_are_located(spark):
    cases = [
        ("One. Two. Three.\nFour, five.", "One. Two! Three.\nFour, six.", "0.0.1:1:1 0.1.1:1:1"),
        ("x. y. z.", "y. x. z.", "0.0.0:1:1 0.0.1:1:1"),
        ("x. y. y. z.", "x. y. z.", "0.0.2:1:0"),
        ("a\n\nb\n\nc", "a\n\nnew\nb\n\nc", "1.0:0:1"),
        ("a\n\nb\n\nc\n\nd", "a\n\nd", "1:2:0"),
        ("a\n\nb. c. d.", "a\n\nb. d. e. f.", "1.0.1:2:3"),
        ("same. text", "same. text", ""),
        ("", "x", "0.0.0:1:1"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = df.select("i", F.array_join(fingerprints.edits(F.col("fa"), F.col("fb")), " ").alias("e"), "fa", "fb").orderBy("i").collect()
    assert [r["e"] for r in got] == [c[2] for c in cases]
    assert all(r["e"] == located(r["fa"], r["fb"]) for r in got)


def test_ranges_of_uneven_ids(spark, monkeypatch):
    """Outliers at both ends of the long range, a crowd in the middle, ties and nulls."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    ids = [-(1 << 63), (1 << 63) - 1, 0, None, None, *range(1000, 1200), *[5000] * 7, *range(10**15, 10**15 + 40)]
    rows = [(d, f"t{i}. u") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.withColumn("r", fingerprints.ranges(docs)).collect()
    known = sorted((r["doc_id"], r["r"]) for r in own if r["doc_id"] is not None)
    assert [r for _, r in known] == sorted(r for _, r in known)
    held = Counter(r["r"] for r in own)
    assert len(held) > 20 and max(held.values()) <= 20
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    got = fingerprints.with_next(docs, lambda d: d, ["text"]).collect()
    assert {r["text"]: r["next"]["text"] for r in got} == want


def test_empty_table(spark):
    assert fingerprints.fingerprint_report(frame(spark, [])).count() == 0


CHAT = [
    (1, 0, "user", "How do I sort a list?\nIt has numbers."),
    (1, 1, "assistant", "Use sorted.\nIt returns a new list."),
    (1, 2, "user", "> use   SORTED.\nIn place?"),
    (1, 3, "user", "> How do I sort a list?\n> It has numbers.\nAlso strings."),
    (1, 4, "assistant", ">> use sorted.\n> In place?\nUse list.sort."),
    (1, 5, "user", "> never said\nHm."),
    (2, 0, "user", None),
    (2, 1, "user", "> How do I sort a list?\nother conversation"),
    (None, 0, "user", "x"),
    (3, None, "user", "> x"),
]
DDL = "conv_id long, turn long, role string, text string, conv string, m string, block string"


def test_quotations_are_linked(spark):
    rows = spark.createDataFrame([(*r, "c", "m", "b") for r in CHAT], DDL)
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked_conversations(rows).collect()}
    assert len(got) == len(CHAT)
    reply = {k: r["reply_to"] for k, r in got.items()}
    assert reply == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 5): None, (2, 0): None, (2, 1): None, (None, 0): None, (3, None): None}
    assert got[(1, 4)]["own_text"] == "Use list.sort." and got[(1, 4)]["root_turn"] == 1 and got[(1, 4)]["depth"] == 2 and got[(1, 4)]["n_quotes"] == 2 and got[(1, 4)]["n_linked"] == 2
    order = sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in order] == [0, 3, 1, 2, 4, 5] and [r["position"] for r in order] == list(range(6))
    assert chat.linked_conversations(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("long", [4, 4096])
def test_long_reply_chains_and_repeated_passages(spark, monkeypatch, long):
    monkeypatch.setattr(chat, "BLOCK", 8)
    monkeypatch.setattr(chat, "LONG", long)
    rows = [(7, 0, "user", "line 0")] + [(7, k, "user", f"> line {k - 1}\nline {k}\nthanks") for k in range(1, 40)]
    rows += [(7, 50 + k, "user", "> thanks\nok") for k in range(30)]
    got = {r["turn"]: r for r in chat.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[k]["reply_to"] == k - 1 and got[k]["depth"] == k and got[k]["root_turn"] == 0 for k in range(1, 40))
    assert all(got[50 + k]["reply_to"] == 1 and got[50 + k]["depth"] == 2 for k in range(30))
    assert sorted(r["position"] for r in got.values()) == list(range(len(rows)))
    order = sorted(got.values(), key=lambda r: (r["root_turn"], r["depth"], r["turn"]))
    assert [r["position"] for r in order] == list(range(len(rows)))


def test_long_conversations_of_odd_rows(spark, monkeypatch):
    """Places in blocks equal places by one window: null turns and conversations, repeated turns, hot threads."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(None, i % 7 if i % 3 else None, "user", f"m{i}") for i in range(60)]
    rows += [(1, i % 20, "user", f"> m0\nr{i}") for i in range(100)] + [(1, 0, "user", "m0"), (2, 3, None, None), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    runs = []
    for long in (4096, 3):
        monkeypatch.setattr(chat, "LONG", long)
        runs.append(sorted(map(str, chat.linked_conversations(df).collect())))
    assert runs[0] == runs[1]


def test_a_turn_of_thousands_is_ordered_by_its_texts(spark):
    """Messages without conversation and with one turn: the places are those of their sorted texts, and no window holds them all."""
    from linkforge.llm import chat

    rows = [(None, 0, ["user", "tool", None][i % 3], None if i % 50 == 7 else f"{'same beginning of the text ' if i % 5 == 0 else ''}{i % 4000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["position"], r["role"] or "", r["own_text"] or "") for r in chat.linked_conversations(docs).collect())
    want = sorted(((r or "", t is not None, t or "") for _, _, r, t in rows))
    assert [x[0] for x in got] == list(range(6000)) and [(a, b) for _, a, b in got] == [(r, t) for r, _, t in want]
