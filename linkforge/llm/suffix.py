"""Exact removal of repeated passages by suffix arrays.

Every string of `LENGTH` bytes that also starts earlier (in a smaller doc_id, or in the same document)
is removed, judged on the input. The corpus is brought down to what can repeat before any suffix is sorted:

1. A string of `LENGTH` bytes contains the smallest hash among its `ANCHOR`-byte strings, its anchor; equal
   strings have equal anchors at equal places. Anchors (about one in 35 bytes) are dealt out by hash
   in binary blocks; one block of a few MB sends a repeated anchor and context once.
2. An anchor's context holds every string with that anchor. An occurrence whose whole context stands
   earlier is covered. Anchors that occur once can't be in a repeated string and go.
3. What is left are anchors with several contexts: the edges of repeated passages. Their contexts, cut
   into `BLOCK`-byte symbols that are aligned at the anchor, form one string for each task. Its suffix array
   is built by linear grouping: groups of suffixes with the same Lyndon prefix are processed in descending
   order, previous-smaller pointers carry each group's mark to the suffixes before it, and a second scan emits
   the order of each group. Runs of neighbours that share enough symbols, with the few bytes
   beside them, are the classes of equal strings; all but the first of a class are covered.
4. An anchor with more than `HOT` contexts is not gathered: its strings are dealt out by their own hash, one of
   each from every batch, and all but the first are covered.

Null text is empty. Documents with fewer bytes than `LENGTH` lose nothing. doc_id is a key: of rows with an
equal doc_id the one with the smaller text hash counts as earlier, and rows that repeat a doc_id with its text
are one document, cleaned alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, U64, buckets_for, fresh, lean, mix, prefix_sums, release, small_batches, span_hash, table, text_chunks, window_hashes

LENGTH, ANCHOR, BLOCK = 100, 32, 16
#: Contexts of one anchor beyond which its strings are rows of their own.
HOT = 1 << 15


# ------------------------------------------------------------------ linear grouping


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers that end in a unique smallest one."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size, place, before = [0] * n, [0] * n, [0] * n, [-1] * n
    at = 0
    while at < n:
        end, c = at, text[order[at]]
        while end < n and text[order[end]] == c:
            group[order[end]] = at
            place[order[end]] = end
            end += 1
        size[at] = end - at
        at = end
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:  # one suffix gets a longer prefix: it becomes the last group of its own
                g = group[p]
                last = g + size[g] - 1
                q, k = order[last], place[p]
                order[last], order[k], place[q], place[p] = p, q, k, last
                size[g] -= 1
                group[p] = last
                size[last] = 1
            end = start
            continue
        times: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by: dict[int, list[int]] = {}
        for p, k in times.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            moved: dict[int, int] = {}
            for p in by[k]:
                g = group[p]
                last = g + size[g] - 1
                q, x = order[last], place[p]
                order[last], order[x], place[q], place[p] = p, q, x, last
                size[g] -= 1
                moved[g] = moved.get(g, 0) + 1
            for p in by[k]:
                group[p] += size[group[p]]
            for g, m in moved.items():
                size[g + size[g]] = m
        end = start
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out


# ------------------------------------------------------------------------ anchors


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(buf: np.ndarray, off: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings that lie in one text."""
    n, w = len(buf), LENGTH - ANCHOR + 1
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(total, ANCHOR)
    h >>= U64(32)
    v = h.astype(np.uint32)
    del h
    v |= np.uint32(1)
    low = _slide(v, w, np.minimum)
    edge = np.zeros(len(low) + 1, np.int32)
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - LENGTH + 1, -1)
    low = np.where(np.cumsum(edge[:-1], dtype=np.int32) > 0, low, np.uint32(0))
    del edge
    pad = np.zeros(w - 1, np.uint32)
    where = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == v)
    return where, span_hash(total, where, where + ANCHOR)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like weight together: what hardly varies compresses away in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: memoryview, kind, n: int) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w).reshape(w, n).T).reshape(-1).view(kind)


ENTRY = "bucket int, piece int, data binary"
#: Blobs that one chunk is dealt into at most, and buckets whose worth of blobs meets in one task to be split.
FAN, TOGETHER = 1 << 12, 8
FOUND = "doc_id long, tie long, pos int, h long, kind int"
_FOUND = [("doc_id", pa.int64()), ("tie", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("kind", pa.int32())]
#: Of a found anchor: its whole context is covered; its context is to be sorted; its strings become rows.
COVERED, EDGE, CROWDED = 0, 1, 2


def _first(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return new


def _dealt(buckets: int) -> tuple[int, int]:
    """Buckets that a chunk is dealt into at once, and parts of each, into which they are split where many chunks' blobs have met."""
    first = min(FAN, buckets)
    return first, buckets // first


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The numbers of the buckets that have rows, and each one's rows as bytes; the work doesn't grow with the number of buckets."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    starts = np.flatnonzero(_first(sorted_)) if len(order) else np.zeros(0, np.int64)
    columns = [x[order] for x in columns]
    data = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        data.append(b"\x00" + b"".join(_planes(x[a:b]) if x.dtype.kind == "i" else x[a:b].tobytes() for x in columns))
    return sorted_[starts].tolist(), data


#: The columns of an entry in its blob; before them goes the part of the bucket, while blobs are yet to be split.
_PART, _COLUMNS = np.dtype(np.uint16), [np.dtype(x) for x in (np.uint32, np.uint64, np.int64, np.int64, np.int32)]


def _unblob(raw: memoryview, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = (len(raw) - 1) // sum(k.itemsize for k in kinds), 1, []
    for k in kinds:
        part = raw[at : at + n * k.itemsize]
        out.append(_unplanes(part, k, n) if k.kind == "i" else np.frombuffer(part, np.uint8).view(k))
        at += n * k.itemsize
    return out


def _entry_batch(which: list[int], piece: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([piece] * len(which), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "piece", "data"])


def _entries(buckets: int):
    many, parts = _dealt(buckets)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by the task alone, which a repeated task shares, whatever the order of its rows
        piece = TaskContext.get().partitionId() % -(-parts // TOGETHER)
        for batch in batches:
            doc, ties = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc_id", "tie"))
            for lo, hi, buf, off in text_chunks(batch, "text", CHUNK_BYTES // 2):
                if len(buf) < LENGTH:
                    continue
                total = prefix_sums(buf)
                pos, h = anchors(buf, off, total)
                if not len(pos):
                    continue
                d = np.searchsorted(off, pos, side="right") - 1
                a = np.minimum(pos - off[d], LENGTH - ANCHOR)
                b = np.minimum(off[d + 1] - pos, LENGTH)
                context = mix(span_hash(total, pos - a, pos + b) + (a * (LENGTH + 1) + b).astype(np.uint64) * U64(0xE7037ED1A0B428DB))
                pos = (pos - off[d]).astype(np.int32)
                name, tie = doc[lo:hi][d], ties[lo:hi][d]
                order = np.lexsort((pos, tie, name, context, h))
                h, context, name, tie, pos = h[order], context[order], name[order], tie[order], pos[order]
                order = _first(h, context, name, tie, pos)  # repeated rows are one document
                h, context, name, tie, pos = h[order], context[order], name[order], tie[order], pos[order]
                once = _first(h, context)
                again = ~once
                if again.any():  # one for each context is enough: these have an earlier one here
                    yield _entry_batch([int(pos[0]) % many], piece, [b"\x01" + _planes(name[again]) + _planes(tie[again]) + _planes(pos[again])])
                h, context, name, tie, pos = h[once], context[once], name[once], tie[once], pos[once]
                bucket = ((h >> U64(32)) % U64(buckets)).astype(np.int64)
                part = [(bucket % parts).astype(_PART)] if parts > 1 else []
                which, data = _blobs(bucket // parts, [*part, (h & U64(0xFFFFFFFF)).astype(np.uint32), context, name, tie, pos])
                yield _entry_batch(which, piece, data)

    return run


def _split(parts: int):
    @lean
    def run(group: pa.Table) -> pa.Table:
        """The blobs of one bucket from many chunks, as one for each of the bucket's parts."""
        first, piece = (group.column(k)[0].as_py() for k in ("bucket", "piece"))
        cols: list[list[np.ndarray]] = [[] for _ in range(len(_COLUMNS) + 1)]
        which, data = [], []
        for x in group.column("data"):
            raw = memoryview(x.as_buffer())
            if raw[0]:  # decided already
                which.append(first * parts)
                data.append(raw.tobytes())
                continue
            for c, x in zip(cols, _unblob(raw, [_PART, *_COLUMNS])):
                c.append(x)
        if cols[0]:
            part, *rest = map(np.concatenate, cols)
            more, blobs = _blobs(part.astype(np.int64), rest)
            which += [first * parts + k for k in more]
            data += blobs
        return pa.Table.from_batches([_entry_batch(which, piece, data)])

    return run


def anchor_entries(slim: DataFrame, buckets: int) -> DataFrame:
    """bucket, piece, data: the anchors of all texts in blobs by bucket.

    A chunk gives `FAN` blobs at most, so they stay large however many buckets the corpus has. Where it has more, the blobs of one
    bucket from a share of the tasks meet once, in the size of some buckets, and are split into its parts there.
    """
    many, parts = _dealt(buckets)
    blobs = slim.mapInArrow(_entries(buckets), ENTRY)
    return blobs if parts == 1 else blobs.groupBy("bucket", "piece").applyInArrow(_split(parts), ENTRY)


def _repeats(hot: int):
    @lean
    def run(group: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        done: list[list[np.ndarray]] = [[] for _ in range(3)]
        bucket = group.column("bucket")[0].as_py()
        for x in group.column("data"):
            raw = memoryview(x.as_buffer())
            if raw[0]:
                n = (len(raw) - 1) // 20
                for k, (at, kind) in enumerate(((1, np.int64), (1 + 8 * n, np.int64), (1 + 16 * n, np.int32))):
                    done[k].append(_unplanes(raw[at:], kind, n))
                continue
            for c, x in zip(cols, _unblob(raw, _COLUMNS)):
                c.append(x)
        out = [[*x] for x in done] + [[np.zeros(sum(map(len, done[0])), np.int64)], [np.zeros(sum(map(len, done[0])), np.int32)]]
        if cols[0]:
            h, context, name, tie, pos = map(np.concatenate, cols)
            order = np.argsort(h, kind="stable")
            new = _first(h[order])
            run_of = np.cumsum(new) - 1
            order = order[np.bincount(run_of)[run_of] > 1]
            h, context, name, tie, pos = h[order], context[order], name[order], tie[order], pos[order]
            order = np.lexsort((pos, tie, name, context, h))
            h, context, name, tie, pos = h[order], context[order], name[order], tie[order], pos[order]
            order = _first(h, context, name, tie, pos)
            h, context, name, tie, pos = h[order], context[order], name[order], tie[order], pos[order]
            if len(h):
                once = _first(h, context)
                run_of = np.cumsum(_first(h)) - 1
                several = np.bincount(run_of, once)[run_of]
                kind = np.where(~once, COVERED, np.where(several > hot, CROWDED, EDGE)).astype(np.int32)
                use = ~once | (several > 1)
                key = (h.astype(np.int64) | (np.int64(bucket) << 32))[use]
                for k, x in enumerate((name[use], tie[use], pos[use], key, kind[use])):
                    out[k].append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(x), t) if x else pa.array([], t) for x, (_, t) in zip(out, _FOUND)], names=[n for n, _ in _FOUND])

    return run


# --------------------------------------------------------------------------- edges

CONTEXTS = "kind int, bucket int, h long, doc_id long, tie long, pos int, head int, string long, context binary"
_CONTEXTS = [("kind", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("pos", pa.int32()), ("head", pa.int32()), ("string", pa.int64()), ("context", pa.binary())]


def _contexts(buckets: int):
    """Edge contexts as bytes; of a crowded anchor's strings one row each and batch, the first.

    Later ones in the batch are covered already and leave as rows of kind COVERED.
    """
    left = LENGTH - ANCHOR

    def crowd(parts: list[tuple[np.ndarray, ...]]) -> list[tuple]:
        h, string, doc, tie, pos = map(np.concatenate, zip(*parts))
        order = np.lexsort((pos, tie, doc, string, h))
        h, string, doc, tie, pos = (x[order] for x in (h, string, doc, tie, pos))
        order = _first(h, string, doc, tie, pos)
        h, string, doc, tie, pos = (x[order] for x in (h, string, doc, tie, pos))
        kind = np.where(_first(h, string), CROWDED, COVERED)
        bucket = (string ^ h) % buckets
        return list(zip(kind.tolist(), bucket.tolist(), h.tolist(), doc.tolist(), tie.tolist(), pos.tolist(), [0] * len(h), string.tolist(), [None] * len(h)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            parts = []
            for d, tie, text, want in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), batch.column("want")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                items = want.values
                pos, h, kind = (items.field(k).to_numpy() for k in ("pos", "h", "kind"))
                for i in np.flatnonzero(kind == EDGE).tolist():
                    p = int(pos[i])
                    rows.append((EDGE, int(h[i] % buckets), int(h[i]), d, tie, p, min(p, left), 0, raw[max(0, p - left) : p + LENGTH]))
                crowded = np.flatnonzero(kind == CROWDED).tolist()
                if crowded:
                    total = prefix_sums(np.frombuffer(raw, np.uint8))
                    for i in crowded:
                        p = int(pos[i])
                        at = np.arange(max(0, p - left), min(p, len(raw) - LENGTH) + 1)
                        fill = lambda x: np.full(len(at), x, np.int64)  # noqa: B023, E731
                        parts.append((fill(h[i]), span_hash(total, at, at + LENGTH).view(np.int64), fill(d), fill(tie), at))
            rows += crowd(parts) if parts else []
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[k : k + 20_000]), _CONTEXTS)], names=[n for n, _ in _CONTEXTS])

    return run


SPAN = "doc_id long, tie long, pos int, size int"


def covered_strings(contexts: list[bytes], heads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(context, shift) of strings that an earlier context of the list has at the same shift to its anchor.

    The contexts are laid on a grid of `LENGTH - ANCHOR` bytes before the anchor and `LENGTH` after its start.
    """
    left, n = LENGTH - ANCHOR, len(contexts)
    full = left + LENGTH
    grid = np.zeros((n, full), np.uint8)
    lo = np.array([left - x for x in heads])
    size = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(n), size)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)] = flat
    hi = lo + size
    total = np.zeros((n, full + 1), np.uint64)
    one = prefix_sums(grid.reshape(-1))
    total = one[:-1].reshape(n, full)
    base = np.arange(n) * full
    first = left % BLOCK
    m = (full - first) // BLOCK
    at = first + BLOCK * np.arange(m)
    starts = (base[:, None] + at).reshape(-1)
    symbol = span_hash(one, starts, starts + BLOCK).reshape(n, m)
    _, names = np.unique(symbol, return_inverse=True)
    text = np.ones((n, m + 1), np.int64)
    text[:, :m] = names.reshape(n, m) + 2
    outside = (at < lo[:, None]) | (at + BLOCK > hi[:, None])  # not whole: equal to nothing
    text[:, :m][outside] = text.max() + 1 + np.arange(int(outside.sum()))
    line = [*text.reshape(-1).tolist(), 0]
    order = np.array(suffix_array(line))
    line = np.array(line)
    rank = np.empty(len(line), np.int64)
    rank[order] = np.arange(len(line))
    most = (LENGTH // BLOCK) + 1
    padded = np.concatenate([line, np.full(most, -1)])
    common, same = np.zeros(len(order), np.int64), np.ones(len(order) - 1, bool)
    for k in range(most):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        common[1:] += same
    runs = {k: np.cumsum(common < k) for k in range(1, most + 1)}
    crowd = {k: np.bincount(r)[r] for k, r in runs.items()}
    out_context, out_shift = [], []
    for s in range(left + 1):
        b = -(-(s - first) // BLOCK) if s > first else 0
        k = (s + LENGTH - at[b]) // BLOCK
        k = min(k, m - b)
        r = rank[np.arange(n) * (m + 1) + b]
        use = np.flatnonzero((lo <= s) & (hi >= s + LENGTH) & (crowd[k][r] > 1))
        if len(use) < 2:
            continue
        head = span_hash(one, base[use] + s, base[use] + at[b])
        tail = span_hash(one, base[use] + at[b] + k * BLOCK, base[use] + s + LENGTH)
        key = mix(mix(head + runs[k][r[use]].astype(np.uint64) * U64(0xA0761D6478BD642F)) * U64(3) + tail)
        _, firsts = np.unique(key, return_index=True)
        later = np.ones(len(use), bool)
        later[firsts] = False
        out_context.append(use[later])
        out_shift.append(np.full(int(later.sum()), s))
    if not out_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_context), np.concatenate(out_shift)


#: Contexts whose suffixes are sorted at once: a bound on memory, as anchors never straddle it.
SORTED = 20_000


def _crowd_spans(group: pa.Table) -> list[np.ndarray]:
    """doc_id, tie, pos of crowded strings that stand earlier."""
    kind, h, string, doc, tie, pos = (group.column(k).to_numpy() for k in ("kind", "h", "string", "doc_id", "tie", "pos"))
    order = np.lexsort((pos, tie, doc, string, h))
    later = ~_first(h[order], string[order])
    same = np.zeros(len(order), bool)
    same[1:] = ~_first(h[order], string[order], doc[order], tie[order], pos[order])[1:]
    hit = np.zeros(len(order), bool)
    hit[order] = later & ~same
    hit |= kind == COVERED
    return [x[hit] for x in (doc, tie, pos)]


@lean
def _covered_spans(group: pa.Table) -> pa.Table:
    kind = group.column("kind").to_numpy()
    edges = group.filter(pa.array(kind == EDGE))
    h, name, tied, place, heads = (edges.column(k).to_numpy() for k in ("h", "doc_id", "tie", "pos", "head"))
    rows = np.lexsort((place, tied, name, h))
    rows = rows[_first(h[rows], name[rows], tied[rows], place[rows])] if len(rows) else rows
    context = edges.column("context").to_pylist()
    doc, tie, pos = _crowd_spans(group.filter(pa.array(kind != EDGE)))
    spans: list[list[np.ndarray]] = [[doc], [tie], [pos.astype(np.int64)], [np.full(len(doc), LENGTH)]]
    at = 0
    while at < len(rows):
        end = min(len(rows), at + SORTED)
        while end < len(rows) and h[rows[end]] == h[rows[end - 1]]:
            end += 1
        part = rows[at:end]
        which, shift = covered_strings([context[i] for i in part.tolist()], heads[part].tolist())
        order = np.lexsort((shift, which))
        which, shift = which[order], shift[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (shift[1:] != shift[:-1] + 1)
        a = np.flatnonzero(new)
        size = np.diff(np.append(a, len(which))) - 1 + LENGTH
        doc, tie, pos = (x[part].astype(np.int64)[which[a]] for x in (name, tied, place))
        for k, x in enumerate((doc, tie, pos - (LENGTH - ANCHOR) + shift[a], size)):
            spans[k].append(x)
        at = end
    cols = [np.concatenate(x) for x in spans]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "tie", "pos", "size"])


# ------------------------------------------------------------------------- operator


def removed_spans(slim: DataFrame, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """doc_id, tie, pos, size of covered stretches; size 0: the whole context of the anchor at pos.

    The number of buckets follows the corpus's bytes unless it is given.
    """
    spark = slim.sparkSession
    small_batches(spark)
    buckets = buckets or buckets_for(spark, slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0, most=24)
    found = table(anchor_entries(slim, buckets).repartition("bucket").groupBy("bucket").applyInArrow(_repeats(hot), FOUND))
    release(spark)
    want = found.where(F.col("kind") != COVERED).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "h", "kind")).alias("want"))
    contexts = slim.join(want, ["doc_id", "tie"]).select("doc_id", "tie", "text", "want").mapInArrow(_contexts(buckets), CONTEXTS)
    some = contexts.groupBy("bucket").applyInArrow(_covered_spans, SPAN)
    whole = found.where(F.col("kind") == COVERED).select("doc_id", "tie", "pos", F.lit(0).alias("size"))
    return whole.unionByName(some)


def _cleaner(schema: T.StructType, raw_in: str, spans_in: str, digest: bool):
    names = [f.name for f in schema.fields]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, spans in zip(batch.column(raw_in), batch.column(spans_in)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(raw))
                if not spans.is_valid or not len(spans.values):
                    kept.append(raw)
                    gone.append(0)
                    runs.append(0)
                    continue
                pos, size = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("pos", "size"))
                a = np.where(size == 0, np.maximum(pos - (LENGTH - ANCHOR), 0), pos)
                b = np.where(size == 0, np.minimum(pos + LENGTH, len(raw)), pos + size)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                out = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                gone.append(int(out.sum()))
                runs.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + out[0]))
            if digest:
                cols = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            else:
                text = pa.array([k.decode(errors="ignore") if ok else None for k, ok in zip(kept, batch.column(raw_in).is_valid().to_pylist())], pa.string())
                cols = [text if f == names[-1] else batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str, d: str, t: str) -> DataFrame:
    """`docs` with the long `d` and the tie `t`, which is 0 throughout where no doc_id repeats."""
    docs = docs.withColumn(d, F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))))
    twice = docs.groupBy(d).count().where("count > 1").limit(1).count()
    return docs.withColumn(t, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))) if twice else F.lit(0).cast("long"))


def _with_spans(docs: DataFrame, doc_id: str, text: str, hot: int) -> tuple[DataFrame, str]:
    """`docs` with the list of their covered stretches, and that column's name."""
    d, t, name = fresh(docs, "_d", "_t", "_spans")
    named = _keyed(docs, doc_id, text, d, t)
    slim = named.select(F.col(d).alias("doc_id"), F.col(t).alias("tie"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    spans = removed_spans(slim, hot).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "size")).alias(name))
    spans = spans.select(F.col("doc_id").alias(d), F.col("tie").alias(t), F.col(name))
    return named.join(spans, [d, t], "left").drop(d, t), name


def removal_report(docs: DataFrame, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text")
    slim = _keyed(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), raw), "doc_id", "text", "_d", "tie")
    # one shuffle of the texts serves both joins
    slim = slim.select(F.col("_d").alias("doc_id"), "tie", "text")
    spans = "spans"
    joined = slim.join(removed_spans(slim, hot).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "size")).alias(spans)), ["doc_id", "tie"], "left")
    joined = joined.select(F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", spans)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.select("doc_id", F.col("text").alias("raw"), spans).mapInArrow(_cleaner(schema, "raw", spans, True), schema)


def without_repeats(docs: DataFrame, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the covered bytes taken out of the text; characters that lose a byte go whole."""
    joined, spans = _with_spans(docs, doc_id, text, hot)
    raw, clean_ = fresh(joined, "_raw", "_clean")
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(clean_, T.StringType())])
    clean = joined.withColumn(raw, F.col(f"`{text}`").cast("binary")).drop(text).mapInArrow(_cleaner(schema, raw, spans, False), schema)
    return clean.select(*[F.col(clean_).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
