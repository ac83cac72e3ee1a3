import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkforge.llm import suffix

from .cases import frame, real


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_linear_grouping_sorts_suffixes(x):
    x = [*x, 0]
    assert suffix.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(rows):
    """Every 100-byte string by dictionary. Rows are (doc_id, text)."""
    seen, out = set(), []
    for d, t in sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\x01" * 100
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out += [(d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())] * rows.count((d, t))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_report_equals_brute_force(spark, hot):
    for docs in (frame(spark), real(spark)):
        want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        got = sorted(map(tuple, suffix.removal_report(docs, hot).collect()), key=str)
        assert got == want


def test_buckets_split_in_two_steps(spark, monkeypatch):
    """With a small fan-out the second step is taken; the spans are those of one step."""
    docs = real(spark).selectExpr("doc_id", "0L tie", "encode(coalesce(text, ''), 'UTF-8') text").where("doc_id is not null").repartition(7)
    want = sorted(map(tuple, suffix.removed_spans(docs).collect()))
    assert want
    monkeypatch.setattr(suffix, "FAN", 16)
    monkeypatch.setattr(suffix, "TOGETHER", 5)
    assert suffix._dealt(256) == (16, 16)
    assert sorted(map(tuple, suffix.removed_spans(docs, buckets=256).collect())) == want


@pytest.mark.parametrize("buckets", [1 << 8, 1 << 17, 1 << 20])
def test_first_exchange_does_not_grow_with_the_buckets(spark, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "0L tie", "encode(coalesce(text, ''), 'UTF-8') text").coalesce(1)
    n_bytes = docs.selectExpr("sum(octet_length(text))").first()[0]
    blobs = docs.mapInArrow(suffix._entries(buckets), suffix.ENTRY).selectExpr("sum(octet_length(data) + 48)", "count(*)").first()
    assert blobs[0] < 1.5 * n_bytes and blobs[1] <= suffix.FAN * (n_bytes // suffix.CHUNK_BYTES * 3 + 3)


def test_planted_passages(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd efgh") for _ in range(n))
    shared = text(400)
    rows = [(i, text(rng.randint(0, 300)) + shared[rng.randint(0, 150) : rng.randint(200, 400)] + text(rng.randint(0, 300))) for i in range(60)]
    rows += [(60, "ab" * 400), (61, shared + shared), (62, "a" * 99), (63, "a" * 101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix.removal_report(docs).collect()), key=str) == brute(rows)


def test_cleaned_documents_keep_columns_and_characters(spark):
    docs = frame(spark)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[5] is None and got[4] == "" and got[2] == "" and got[1] == docs.where("doc_id = 1").first()["text"]


def test_empty_table(spark):
    assert suffix.removal_report(frame(spark, [])).count() == 0
