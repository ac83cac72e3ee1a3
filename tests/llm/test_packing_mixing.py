import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers
from tokenizers import Tokenizer

from linkforge.llm import mixing, packing

from .cases import frame, real

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(docs, out):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // 4096)


def test_packing_round_trip(spark):
    for docs in (frame(spark), real(spark)):
        used, least = check_packing(docs, packing.best_fit_packing(docs, PATH))
        assert used <= least + 1
    assert packing.best_fit_packing(frame(spark, []), PATH).count() == 0


def test_fullest_is_optimal():
    for room in range(1, 30):
        counts = {3: 2, 5: 1, 7: 3, 11: 1}
        best = max(s for s in (sum(k * n for k, n in zip(counts, c)) for c in product(*[range(n + 1) for n in counts.values()])) if s <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and not Counter(got) - Counter(counts)


def water(sizes, weights):
    open_, goal, left = set(range(len(sizes))), [0.0] * len(sizes), 1.5 * sum(sizes)
    while open_:
        x = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * x > 2 * sizes[i]}
        if not full:
            for i in open_:
                goal[i] = weights[i] * x
            break
        for i in full:
            goal[i], left = 2.0 * sizes[i], left - 2 * sizes[i]
        open_ -= full
    return goal


def test_mix_hits_targets_and_reruns_agree(spark):
    for docs in (frame(spark), real(spark)):
        rows = mixing.mix_sources(docs).collect()
        assert sorted(rows, key=str) == sorted(mixing.mix_sources(docs.repartition(5)).collect(), key=str)
        sizes, by = Counter(), defaultdict(list)
        for r in docs.collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        goal = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
        assert len(rows) == docs.count()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
            by[r["source"]].append(r)
        for s, x in by.items():
            assert abs(sum(r["size"] * r["copies"] for r in x) - goal[s]) <= max(r["size"] for r in x)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_rounding_tree(spark):
    """Small leaves give several levels; the total stays within one document and expectations hold."""
    slim = spark.range(3000).selectExpr("'s' source", "id doc_id", "10 + id % 7 size", "id row_key", "1.3 rate", "3000l n")
    slim = slim.selectExpr("source", "doc_id", "cast(size as long) size", "row_key", "cast(rate as double) rate", "n")
    got = mixing.pivotal(slim, leaf=16, arity=4).collect()
    assert len(got) == 3000
    total, want = sum(r["size"] * r["copies"] for r in got), 1.3 * sum(r["size"] for r in got)
    assert abs(total - want) <= 16
    assert abs(sum(r["copies"] for r in got if r["size"] == 10) / sum(1 for r in got if r["size"] == 10) - 1.3) < 0.12


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_new_words_of_many_texts_are_learnt_together(monkeypatch):
    """Texts of all kinds at once give the ids of each alone, and the tokenizer is asked a few times, not once a text."""
    plain = Tokenizer.from_file(PATH)
    texts = [f"wo{chr(97 + k % 26)}ra{k}\nThe Haus{'en' * (k % 7)}, {'x' * k}! a  b {k * 7}" for k in range(200)]
    texts += ["", " ", "\n", "Ünïcode wörter.", "漢字 words and Words", "İstanbul e\u0301te", "<|endoftext|> x", "tab\tand\u00a0space"]
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    words, asked = packing.WordTokens(PATH), []
    encode, runs = words.encode, words.encode_runs
    monkeypatch.setattr(words, "encode", lambda parts: asked.append(len(parts)) or encode(parts))
    monkeypatch.setattr(words, "encode_runs", lambda parts: asked.append(len(parts)) or runs(parts))
    assert words.many(texts) == want
    assert len(asked) <= 5, asked
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "PORTION", 500)
    assert [x for part in packing.portions([*texts, None]) for x in words.many(part)] == [*want, b""]
    assert [words(t) for t in texts] == want
