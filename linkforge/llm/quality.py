"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns of the whole corpus (3 ** labellers of them at most, whatever its size)
estimates how often each labeller is right for either class, and so the posterior of each pattern. These
posteriors are the soft labels from which a linear scorer over hashed words and character classes is
trained, on the `SAMPLE` documents with the smallest hash. The driver holds of each the words' bins and their shares, at
most 2 ** BITS of six bytes whatever the text's length. The scorer then reads the whole of every text.

A null or blank text has score 0 and is not kept. Repeated rows score alike and are one in the sample. An empty table gives no rows, and
its model keeps nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, prefix_sums, small_batches, span_hash, text_chunks, words

#: Documents on which the scorer is trained, at most.
SAMPLE = 4000
BITS = 14
KEEP = 0.5

# Frequent function words of the languages that the labellers know.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are with as be by this at from or an not have he they which "
    "de la le les et des en un une que est pour dans qui sur pas plus au par avec "
    "der die das und ist in den von zu mit sich auf für nicht ein eine dem als auch "
    "el los las y del se por con una su para es al lo como más"
).split()

# classes of bytes: lower, upper, digit, white space, line feed, stop, junk symbol, bar, exclamation, other symbol, beyond ASCII
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*@^~=<>{}[]\\"]] = 6
_CLASS[ord("|")], _CLASS[ord("!")] = 7, 8
_CLASS[128:] = 10
CLASSES = 11


def _known_words() -> np.ndarray:
    raw = " ".join(FUNCTION_WORDS).encode()
    return np.unique(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


_KNOWN = _known_words()


def measures(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Shares that the labellers judge, the texts' word hashes, and each text's first word."""
    rows = len(off) - 1
    text = np.repeat(np.arange(rows), np.diff(off))
    k = np.bincount(text * CLASSES + _CLASS[buf], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(float)
    h, first = words(buf, off)
    n_words = np.diff(first).astype(float)
    ink = np.maximum(1, k.sum(1) - k[:, 3] - k[:, 4])
    letters = k[:, 0] + k[:, 1] + k[:, 10]
    known = np.zeros(len(h) + 1)
    known[1:] = np.cumsum(_KNOWN[np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)] == h)
    repeated, distinct = np.zeros(rows), np.zeros(rows)
    if len(buf):
        ends = np.flatnonzero(buf == 10)
        bounds = np.unique(np.concatenate([ends + 1, off]))
        a, b = bounds[:-1], bounds[1:]
        line = span_hash(prefix_sums(buf), a, b)
        own = np.searchsorted(off, a, side="right") - 1
        size = (b - a).astype(float)
        order = np.lexsort((a, line, own))
        again = np.zeros(len(a), bool)
        again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
        again &= size > 20
        repeated = np.bincount(own, size * again, minlength=rows)[:rows] / np.maximum(1, np.diff(off))
        who = np.repeat(np.arange(rows), np.diff(first))
        order = np.lexsort((h, who))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])
        distinct = np.bincount(who[order][new], minlength=rows)[:rows] / np.maximum(1, n_words)
    shares = {
        "words": n_words,
        "letters": letters / ink,
        "capitals": k[:, 1] / np.maximum(1, letters),
        "junk": k[:, 6] / ink,
        "bars": k[:, 7] / np.maximum(1, n_words),
        "shouts": k[:, 8] / np.maximum(1, n_words),
        "digits": k[:, 2] / ink,
        "stops": k[:, 5] / np.maximum(1, n_words),
        "known": (known[first[1:]] - known[first[:-1]]) / np.maximum(1, n_words),
        "repeated": repeated,
        "distinct": distinct,
    }
    return shares, h, first


#: (measure, bad if under, bad if over, good from, good to); a vote where the value lies in neither is none.
LABELLERS = (
    ("words", 8, np.inf, 40, np.inf),
    ("letters", 0.6, np.inf, 0.85, np.inf),
    ("capitals", -1, 0.5, 0, 0.12),
    ("junk", -1, 0.06, 0, 0.005),
    ("bars", -1, 0.2, -1, -1),
    ("shouts", -1, 0.2, -1, -1),
    ("digits", -1, 0.12, 0, 0.03),
    ("known", 0.03, np.inf, 0.15, 0.75),
    ("repeated", -1, 0.25, 0, 0.001),
    ("distinct", 0.12, np.inf, 0.3, np.inf),
)


def votes(shares: dict[str, np.ndarray]) -> np.ndarray:
    """0 bad, 1 good, 2 none: a column for each labeller."""
    out = []
    for name, under, over, lo, hi in LABELLERS:
        x = shares[name]
        out.append(np.where((x < under) | (x > over), 0, np.where((x >= lo) & (x <= hi), 1, 2)))
    return np.stack(out, 1)


_RADIX = 3 ** np.arange(len(LABELLERS))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of `good` for each vote pattern, and P(vote | class) of each labeller.

    Starts from the majority, so that class 1 is the one that `good` votes point to.
    """
    post = (0.5 + (patterns == 1).sum(1)) / (1 + (patterns != 2).sum(1))
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            table[:, :, v] = w @ (patterns == v) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = np.clip(w.sum(1) / w.sum(), 1e-3, 1)
        log = np.log(prior)[:, None] + sum(np.log(table[:, j, patterns[:, j]]) for j in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return post, table


EXTRA = len(LABELLERS) + 1


def features(shares: dict[str, np.ndarray], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word bins of all words, and dense shares with a constant, each within 0 and 1."""
    bins = (h >> U64(64 - BITS)).astype(np.int64)
    dense = [np.ones(len(first) - 1), np.minimum(1, np.log1p(shares["words"]) / 8)]
    dense += [np.clip(shares[name], 0, 1) for name, *_ in LABELLERS[1:]]
    return bins, np.stack(dense, 1)


def mean_weight(weights: np.ndarray, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins) + 1)
    total[1:] = np.cumsum(weights[bins])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by full gradient steps: weights of word bins and of shares.

    A row has its bins, the share of its words in each, the dense shares and the label.
    """
    w, v = np.zeros(1 << BITS), np.zeros(EXTRA)
    first = np.concatenate([[0], np.cumsum([len(b) for b, *_ in rows])])
    bins, share = np.concatenate([b for b, *_ in rows]).astype(np.int32), np.concatenate([x for _, x, *_ in rows]).astype(float)
    dense, y = np.stack([d for _, _, d, _ in rows]), np.array([p for *_, p in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(first))
    for _ in range(rounds):
        seen = np.bincount(owner, w[bins] * share, minlength=len(rows))
        p = 1 / (1 + np.exp(-(seen + dense @ v)))
        g = (p - y) / len(y)
        w -= rate * 8 * (np.bincount(bins, g[owner] * share, minlength=len(w)) + decay * w)
        v -= rate * (dense.T @ g + decay * v)
    return w, v


def classify(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, votes (one digit for each labeller), weak_label, score, keep of every document."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    small_batches(slim.sparkSession)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_chunks(batch, "text", rows=4096):
                x, n = np.unique(votes(measures(buf, off)[0]) @ _RADIX, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    found = slim.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers rows at most
    codes = np.array(sorted(r["pattern"] for r in found), np.int64)
    seen = {r["pattern"]: r["n"] for r in found}
    if len(codes):
        post, _ = expectation_maximisation(codes[:, None] // _RADIX % 3, np.array([seen[int(c)] for c in codes], float))
    else:
        codes, post = np.zeros(1, np.int64), np.zeros(1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_chunks(batch, "text", rows=4096):
                shares, h, first = measures(buf, off)
                label = post[np.searchsorted(codes, votes(shares) @ _RADIX)]
                bins, dense = features(shares, h, first)
                bags = [np.unique(bins[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
                kept = [x.astype(np.uint16).tobytes() for x, _ in bags]
                share = [(n / max(1, n.sum())).astype(np.float32).tobytes() for _, n in bags]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(share, pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary()), pa.array(label)], names=["bins", "share", "dense", "label"])

    # ordered by the id's hash and then the text's, so that ids that repeat or lack are sampled alike in every run
    hashed = slim.withColumn("h", F.struct(F.xxhash64("doc_id").alias("d"), F.xxhash64("text").alias("t")))
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    bound = F.struct(F.lit(last["d"] if last else 0).cast("long").alias("d"), F.lit(last["t"] if last else 0).cast("long").alias("t"))
    chosen = hashed.where(F.col("h") <= bound).dropDuplicates(["h"]).select("text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = chosen.mapInArrow(sampled, "bins binary, share binary, dense binary, label double").collect()  # a bounded sample of bounded rows
    if rows:
        rows = sorted((r["bins"], r["share"], r["dense"], r["label"]) for r in rows)
        w, v = train([(np.frombuffer(b, np.uint16), np.frombuffer(x, np.float32), np.frombuffer(d), y) for b, x, d, y in rows])
    else:
        w, v = np.zeros(1 << BITS), np.zeros(EXTRA)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch, "text", rows=4096):
                shares, h, first = measures(buf, off)
                x = votes(shares)
                bins, dense = features(shares, h, first)
                p = 1 / (1 + np.exp(-(mean_weight(w, bins, first) + dense @ v)))
                p = np.where(shares["words"] > 0, p, 0.0)
                at = np.minimum(np.searchsorted(codes, x @ _RADIX), len(codes) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(["".join(map(str, r)) for r in x.tolist()]), pa.array(post[at]), pa.array(p), pa.array(p >= KEEP)], names=["doc_id", "votes", "weak_label", "score", "keep"]
                )

    return slim.mapInArrow(score, "doc_id long, votes string, weak_label double, score double, keep boolean")
