"""Every stage against brute force on what its predecessor kept."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from linkforge.llm import mixing

from . import test_ngram_join, test_suffix
from .cases import SF, frame, real


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def check(spark, docs):
    raw, known, single, cut, mixed, packed = stages(spark, docs)
    for x in (known, single, cut, mixed):
        assert x.columns == raw.columns
    rows = lambda x: [tuple(r) for r in x.collect()]
    assert not Counter(rows(known)) - Counter(rows(raw))
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in known.collect())
    pairs = [(r["doc_id"], r["text"]) for r in known.collect()]
    keep = {d for d, n, c in test_ngram_join.brute(pairs) if d == c or n == 0}
    assert {r["doc_id"] for r in single.collect()} == keep and single.count() == len(keep)
    gone = {d: g for d, _, g, _, _ in test_suffix.brute([(r["doc_id"], r["text"]) for r in single.collect()])}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in cut.collect():
        lost = len(before[r["doc_id"]].encode()) - len(r["text"].encode())
        assert gone[r["doc_id"]] <= lost <= gone[r["doc_id"]] + 6 and r["n_chars"] == len(r["text"])
    copies = Counter()
    for r in mixing.mix_sources(cut).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed.collect()) == want


def test_stages_on_documents(spark):
    check(spark, real(spark))


def test_stages_on_odd_rows(spark):
    # a row without a doc_id has no place in components: the contract's tables have none
    check(spark, frame(spark).where("doc_id <> 17"))


def test_clean_documents_stay(spark):
    raw = real(spark)
    kept = corpus_pipeline.languages(spark, raw, SF)
    assert kept.count() >= 0.99 * raw.where("text rlike '\\\\p{L}'").count()


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
