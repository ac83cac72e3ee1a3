"""Periodic runs: maximal stretches of words that repeat with a period, after Stoye and Gusfield.

Per document, over its words as symbols:

1. The suffix tree, as the intervals of the sorted suffixes and their common prefixes. Suffixes are sorted by doubling, and only those that share their
   first words with another: a run of at least `LEAST` words holds a tandem repeat of more than a quarter of that, so shallower nodes of the tree
   can't matter and are never made.
2. At each node the leaf list of the smaller half is traversed: for leaf i and the node's depth D, i and i + D (or i - D and i) on different sides of the node
   are a branching tandem repeat, one that doesn't go on to the right. A leaf is in a smaller half at most log n times.
3. Branching repeats are rotated to the left as long as a repeat remains; equal stretches merge, with their smallest period.

Symbols are numbered by the words themselves, and no two documents share one, so nothing is decided by a hash. A task holds the words of some MB of text, or of
one longer text, with some 150 bytes a word. There is no exchange.

Null text has no words. Each row is a document of its own, repeated or not; a null doc_id counts as the empty string. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_chunks

#: Words of a run, at least.
LEAST = 12
#: Leaves of smaller halves, and symbols of rotations, looked at together.
TOGETHER = 1 << 20

REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_REPORT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (x, y), equal for equal pairs."""
    return np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by]; past the end a number for each place that nothing else has."""
    top = int(x.max(initial=0)) + 1
    return np.concatenate([x[by:], top + np.arange(min(by, len(x)))])


def sorted_suffixes(symbols: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first `depth` symbols with another of the same document, in order, and each one's common prefix with the one before (0 for other beginnings)."""
    levels, size = [(1, symbols)], 1
    while size < depth:
        by = min(size, depth - size)
        levels.append((size + by, _pairs(levels[-1][1], _shifted(levels[-1][1], by))))
        size += by
    kind, count = np.unique(_pairs(levels[-1][1], doc), return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(count) - count)[kind]
    levels[-1] = (size, rank)
    at = np.flatnonzero(count[kind] > 1)
    all_, first = at, rank
    while len(at):
        a, b = rank[at], rank[at + size]  # the shared symbols end before the document does
        order = np.lexsort((b, a))
        at, a, b = at[order], a[order], b[order]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.ones(len(at), bool)
        group[1:] = a[1:] != a[:-1]
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[at] = a + begin - np.maximum.accumulate(np.where(group, place, 0))
        size *= 2
        levels.append((size, rank))
        single = new & np.append(new[1:], True)
        at = at[~single]
    order = all_[np.argsort(rank[all_])]
    common = np.zeros(len(order), np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    same = first[x] == first[y]
    for size, r in reversed(levels):
        inside = np.flatnonzero(same & (np.maximum(x, y) < len(r)))
        equal = inside[r[x[inside]] == r[y[inside]]]
        common[1 + equal] += size
        x[equal] += size
        y[equal] += size
    return order, common


def _halves(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place t > 0: the last place before it with a prefix no longer, and the first after it with a shorter one. They bound the two sides of the node that splits at t."""
    n, c = len(common), common.tolist()
    left, right, stack = [0] * n, [n] * n, []
    for t in range(n):
        while stack and c[stack[-1]] > c[t]:
            right[stack.pop()] = t
        left[t] = stack[-1] if stack else 0
        stack.append(t)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_repeats(order: np.ndarray, common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, D): the D symbols at i stand again at i + D, and the repeat does not go on."""
    where = np.full(n, -1, np.int64)
    where[order] = np.arange(len(order))
    left, right = _halves(common)
    node = np.flatnonzero(common > 0)
    low, high = left[node], right[node]
    small = node - low <= high - node
    begin, end = np.where(small, low, node), np.where(small, node, high)
    other, stop = np.where(small, node, low), np.where(small, high, node)
    size, found = end - begin, []
    total = np.cumsum(size)
    k = 0
    while k < len(node):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + TOGETHER, side="right")))
        of = np.repeat(np.arange(k, to), size[k:to])
        leaf = np.arange(len(of)) - np.repeat(np.cumsum(size[k:to]) - size[k:to], size[k:to]) + begin[of]
        i, depth = order[leaf], common[node[of]]
        for j in (i + depth, i - depth):
            there = np.where((j >= 0) & (j < n), where[np.clip(j, 0, n - 1)], -1)
            hit = (there >= other[of]) & (there < stop[of])
            found.append((np.minimum(i, j)[hit], depth[hit]))
        k = to
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rotated(symbols: np.ndarray, i: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first place from which each repeat can be read: it moves left as long as the symbol before equals the one a period on."""
    start, open_, step = i.copy(), np.arange(len(i)), 8
    while len(open_):
        more = []
        for k in range(0, len(open_), max(1, TOGETHER // step)):
            part = open_[k : k + max(1, TOGETHER // step)]
            at = start[part][:, None] - np.arange(1, step + 1)
            equal = (at >= 0) & (symbols[np.maximum(at, 0)] == symbols[np.maximum(at, 0) + period[part][:, None]])
            run = np.where(equal.all(1), step, equal.argmin(1))
            start[part] -= run
            more.append(part[run == step])
        open_ = np.concatenate(more)
        step = min(4 * step, 4096)
    return start


def maximal_runs(symbols: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. Each document's symbols end with one that stands nowhere else."""
    half = least // 2
    depth = max(1, half // 2 + 1)  # every period up to half has a multiple from here to half
    order, common = sorted_suffixes(symbols, doc, depth)
    i, period = branching_repeats(order, common, len(symbols))
    start, end = rotated(symbols, i, period), i + 2 * period
    long_ = end - start >= least
    out: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[long_].tolist(), end[long_].tolist(), period[long_].tolist()):
        out[s, e] = min(p, out.get((s, e), p))
    rows = []
    for (s, e), p in out.items():
        for q in range(1, min(p, depth)):
            if p % q == 0 and np.array_equal(symbols[s : e - q], symbols[s + q : e]):
                p = q
                break
        rows.append((s, e - s, p))
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def echoed(words: list[bytes], h: int) -> list[bytes]:
    """One document in ten, by its hash, repeats a part of itself to its end."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def document_runs(texts: list[bytes], hashes: list[int | None], least: int = LEAST) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text; a hash, where given, says whether its words are `echoed`."""
    names: dict[bytes, int] = {}
    split, parts = [], []
    for text, h in zip(texts, hashes):
        words = text.split()  # of bytes: at \x20 and \x09-\x0D alone
        words = words if h is None else echoed(words, h)
        split.append(words)
        parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
    ends = [np.array([len(names) + k]) for k in range(len(texts))]
    symbols = np.concatenate([x for pair in zip(parts, ends) for x in pair]) if texts else np.zeros(0, np.int64)
    sizes = np.array([len(p) + 1 for p in parts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs = maximal_runs(symbols, doc, least)
    first = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(runs[:, 0], np.append(first, len(symbols)))
    for k, words in enumerate(split):
        own = runs[cuts[k] : cuts[k + 1]].copy()
        own[:, 0] -= first[k]
        yield words, own


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for lo, hi, buf, off in text_chunks(batch, "text"):
        data = buf.tobytes()
        yield lo, hi, [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _report(least: int, echo: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, texts in _slices(batch):
                own = ids[lo:hi]
                hashes = [zlib.crc32(str("" if d is None else d).encode()) if echo else None for d in own]
                rows = []
                for d, (words, runs) in zip(own, document_runs(texts, hashes, least)):
                    best = min(map(tuple, runs.tolist()), key=lambda r: (-r[1], r[0], r[2]), default=None)
                    said = "".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist())
                    kept = b" ".join(collapsed(words, runs))
                    rows.append((d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPORT)], schema=_REPORT)

    return run


def _collapse(column: str, least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("there").to_pylist()
            for lo, hi, texts in _slices(batch):
                out = []
                for text, (words, runs) in zip(texts, document_runs(texts, [None] * len(texts), least)):
                    out.append(b" ".join(collapsed(words, runs)) if len(runs) else text)  # text without a run stays as it stands
                out = [t if ok else None for t, ok in zip(out, there[lo:hi])]
                rest = [batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c not in ("text", "there")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary()).cast(pa.string())], names=[*(c for c in batch.schema.names if c not in ("text", "there")), column])

    return run


def run_report(docs: DataFrame, least: int = LEAST, echo: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run, digests of all runs and of the words that stay, of every document."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    return slim.mapInArrow(_report(least, echo), REPORT)


def without_runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): each text with the repeating words of its runs taken out; one without a run, or null, is unchanged."""
    small_batches(docs.sparkSession)
    value = F.col(f"`{text}`").cast("binary")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(value, F.lit(b"")).alias("text"), value.isNotNull().alias("there"))
    kind = dict(docs.dtypes)[doc_id]
    return slim.mapInArrow(_collapse("text", least), f"doc_id {kind}, text string")
