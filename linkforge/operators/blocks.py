"""Products of two tables in blocks, for pairs beyond `PAIRS`: parts of the queries meet blocks of the gallery, each meeting is a group of its own.

A meeting is worked off in tiles of about `TILE` pairs, so its memory does not grow with the tables. What it returns are few rows for each query;
sums that decide are made again in the order of the scan, and whatever a rounding might have moved is kept until then. So the results are those of the
expressions. Vectors that are no plain ones (none, another length, a missing or infinite value) don't enter: `odd` says which, and they meet by expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

#: Pairs up to which expressions over a cross join are quicker.
PAIRS = 1 << 20
#: Rows of a part and of a block with vectors, of a part and of a block without, and pairs of a tile.
PART, BLOCK, SLIM_PART, SLIM_BLOCK, TILE = 4096, 16384, 8192, 1 << 17, 1 << 20
#: Pairs of places up to which their scores are handed to every task.
PLACES = 1 << 18
#: What rounding may move a product by, for each unit of the vectors' lengths, and a score in ten thousandths.
SLACK, UNSURE = 1e-11, 1e-6
#: Records among which a query's first candidates are found.
FIRST = 2048


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def in_order(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of `q` and j of `x`, summed in the order of the scan."""
    out = np.empty(len(i))
    for a in range(0, len(i), 65536):
        out[a : a + 65536] = np.add.accumulate(q[i[a : a + 65536]] * x[j[a : a + 65536]], axis=1)[:, -1]
    return out + 0.0  # no negative zero


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def rounded(v: np.ndarray, exact: Callable[[tuple], np.ndarray] | None = None, unsure: float = UNSURE) -> np.ndarray:
    """`v` to four places, half up, as Spark rounds. Where that hangs on the last bits, `exact` says what v is there."""
    r = v * 1e4 + 0.5
    out = np.floor(r)
    at = np.nonzero(np.abs(r - np.rint(r)) < unsure)
    if len(at[0]):
        own = v[at] if exact is None else exact(at)
        out[at] = [float(Decimal(repr(float(x))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10000) for x in own]
    return out / 1e4


def size_of(*columns: tuple[DataFrame, str]) -> int:
    """The commonest length of the vectors of all tables."""
    n = [d.select(F.size(c).alias("n")).where("n > 0").groupBy("n").count() for d, c in columns]
    found = n[0].unionByName(n[1]).groupBy("n").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 1


def odd(v: Column, size: int) -> Column:
    """Whether the vector is no plain one of that length."""
    wrong = F.exists(v, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(v) != size) | wrong, F.lit(True))


def meet(left: DataFrame, right: DataFrame, run: Callable, schema: str, sizes: tuple[int, int], part: int | None = None, block: int | None = None, dealt: Sequence[Column | str] | None = None) -> DataFrame:
    """`run` on each part of `left` beside each block of `right`; `dealt` are the columns that choose the part, and the first column the block."""
    part, block = part or PART, block or BLOCK
    cores = left.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-sizes[1] // block))
    parts = max(1, -(-sizes[0] // part), min(-(-sizes[0] // 256), -(-3 * cores // blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_part", F.pmod(F.xxhash64(*(dealt or left.columns[:1])), F.lit(parts)).cast("int")).withColumn("_block", each(blocks))
    b = right.withColumn("_block", F.pmod(F.xxhash64(right.columns[0]), F.lit(blocks)).cast("int")).withColumn("_part", each(parts))
    a, b = (x.repartition(min(8192, parts * blocks), "_part", "_block").groupBy("_part", "_block") for x in (a, b))
    return a.cogroup(b).applyInArrow(run, schema)


def tiles(rows: int, columns: int):
    step = max(1, TILE // max(1, columns))
    return ((a, min(rows, a + step)) for a in range(0, rows, step))


def best(i: np.ndarray, order: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Places of the first `k` of each i by `order`."""
    at = np.lexsort((*reversed(order), i))
    s = i[at]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return at[np.arange(len(s)) - begin < k]


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


# ---------------------------------------------------------------------------- vectors


def nearest(queries: DataFrame, gallery: DataFrame, k: int, sizes: tuple[int, int]) -> DataFrame:
    """query, candidate, similarity: from each block the `k` nearest of each query (query, q) among (candidate, x), plain vectors all; ties by candidate."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("candidate", pa.int64()), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, x, ids, names = matrix(left.column("q")), matrix(right.column("x")), numbers(left, "query"), numbers(right, "candidate")
        slack, n, out = SLACK * (1 + lengths(q) * lengths(x).max()), len(x), []
        for a, b in tiles(len(q), n):
            s = q[a:b] @ x.T
            if n > k:
                i, j = np.nonzero(s >= (np.partition(s, n - k, axis=1)[:, n - k] - slack[a:b])[:, None])
            else:
                i, j = map(np.ravel, np.indices(s.shape))
            v = in_order(q[a:b], x, i, j)
            at = best(i, (-v, names[j]), k)
            out.append((ids[a:b][i[at]], names[j[at]], v[at]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return meet(queries.select("query", "q"), gallery.select("candidate", "x"), run, "query long, candidate long, similarity double", sizes)


def highest(queries: DataFrame, gallery: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """query, group, similarity: from each block the largest product of each query (query, q) with each group of (candidate, group, x), plain vectors all."""
    kind = dict(gallery.dtypes)["group"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("group").combine_chunks().dictionary_encode(null_encoding="encode")
        schema = pa.schema([("query", pa.int64()), ("group", names.type.value_type), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        code = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, first = code[order], np.unique(code[order], return_index=True)[1]
        counts = np.diff(np.r_[first, len(code)])
        q, x, ids = matrix(left.column("q")), matrix(right.column("x"))[order], numbers(left, "query")
        slack, values, which = SLACK * (1 + lengths(q) * lengths(x).max()), [], []
        for a, b in tiles(len(q), len(x)):
            s = q[a:b] @ x.T
            least = np.maximum.reduceat(s, first, axis=1) - slack[a:b, None]
            i, j = np.nonzero(s >= np.repeat(least, counts, axis=1))
            top = np.full(least.shape, -np.inf)
            np.maximum.at(top, (i, code[j]), in_order(q[a:b], x, i, j))
            values.append(top.ravel())
            which.append(np.repeat(ids[a:b], len(first)))
        groups = pa.array(np.tile(np.arange(len(first), dtype=np.int32), len(q)))
        return pa.table([pa.array(np.concatenate(which)), names.dictionary.take(groups), pa.array(np.concatenate(values))], schema=schema)

    found = meet(queries.select("query", "q"), gallery.select("candidate", "group", "x"), run, f"query long, group {kind}, similarity double", sizes)
    return found.groupBy("query", "group").agg(F.max("similarity").alias("similarity"))


def above(queries: DataFrame, gallery: DataFrame, modes: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], n_modes: int, sizes: tuple[int, int]) -> DataFrame:
    """query, above array<long>: in each block, for each mode the number of candidates (candidate, x) that stand before the right one of a query (query, q, right, scores).

    `modes` gives the scores of pairs from their rounded faces, queries and candidates; they are rounded to four places, and ties go by candidate.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("above", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, x, ids, names = matrix(left.column("q")), matrix(right.column("x")), numbers(left, "query"), numbers(right, "candidate")
        wanted, scores = numbers(left, "right"), matrix(left.column("scores"))
        unsure = UNSURE + 1e4 * SLACK * lengths(q).max() * lengths(x).max()
        counts = np.zeros((len(q), n_modes), np.int64)
        face = lambda s: np.clip((s + 1) / 2, 0.0, 1.0)
        for a, b in tiles(len(q), len(x)):
            f = rounded(face(q[a:b] @ x.T), lambda at: face(in_order(q[a:b], x, *at)), unsure)  # noqa: B023
            earlier = names[None, :] < wanted[a:b, None]
            for m, v in enumerate(modes(f, ids[a:b, None], names[None, :])):
                v, least = rounded(v), scores[a:b, m][:, None]
                counts[a:b, m] = np.count_nonzero((v > least) | ((v == least) & earlier), axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, n_modes, dtype=np.int32)), pa.array(counts.ravel()))
        return pa.table([pa.array(ids), lists], schema=schema)

    return meet(queries.select("query", "q", "right", "scores"), gallery.select("candidate", "x"), run, "query long, above array<long>", sizes)


# --------------------------------------------------------------------------- metadata

_BANDS = np.array([scoring.BANDS[-1][1], *[s for _, s in reversed(scoring.BANDS[:-1])], scoring.NEUTRAL])
_DATES = np.array([0.2, *[s for _, s in reversed(scoring.DATE_BANDS)], scoring.NEUTRAL])
_UNKNOWN = len(_BANDS) - 1
_TEXTS = ("sex", "detected_sex")


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """One number for each distinct value of all columns, -1 for none."""
    d = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks().dictionary_encode()
    all_, at, out = d.indices.fill_null(-1).to_numpy(zero_copy_only=False), 0, []
    for x in columns:
        out.append(all_[at : at + len(x)])
        at += len(x)
    return out


class Records:
    """The columns of one side that metadata scores need, as arrays; numbers with what is unknown apart, as no number is a value too."""

    def __init__(self, t: pa.Table, places: dict[bytes, int]):
        self.pos = numbers(t, "pos")
        self.place = np.array([places[p] for p in t.column("place").to_pylist()], np.int64)
        day = t.column("event_day").combine_chunks().cast(pa.int32())
        self.value, self.none = {}, {}
        for name, c in (("age", t.column("age").combine_chunks()), ("height", t.column("height_cm").combine_chunks()), ("day", day)):
            self.none[name] = c.is_null().to_numpy(zero_copy_only=False)
            self.value[name] = pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.float64)

    def steps(self) -> np.ndarray:
        """The step of five years of each record, one for what has none."""
        age, none = self.value["age"], self.none["age"]
        plain = ~none & (np.abs(age) < 1000)
        return np.where(plain, np.floor(np.where(plain, age, 0) / 5), np.where(none, 9e6, 8e6)).astype(np.int64)

    def keep(self, at: np.ndarray) -> None:
        self.pos, self.place = self.pos[at], self.place[at]
        for d in (self.value, self.none):
            for name in d:
                d[name] = d[name][at]


def _banded(d: np.ndarray, limits: Sequence[float]) -> np.ndarray:
    """How many of the limits each difference stays within."""
    out = (d <= limits[0]).astype(np.int8)
    for x in limits[1:]:
        out += d <= x
    return out


def _part_scores(x: Records, y: Records, i: slice | np.ndarray, j: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Age, height and date scores of the records i of `x` with j of `y`; `sign` is 1 where the gallery is ante-mortem."""
    out = []
    for name in ("age", "height", "day"):
        d = x.value[name][i][:, None] - y.value[name][j][None, :]
        if name == "day":
            d = d * sign  # the later day is the post-mortem one's
            c = _banded(d, [n for n, _ in scoring.DATE_BANDS])
            c[d < 0] = 0
            unknown, score = len(_DATES) - 1, _DATES
        else:
            c = _banded(np.abs(d, out=d), [n for n, _ in scoring.BANDS[:-1]])
            unknown, score = _UNKNOWN, _BANDS
        c[x.none[name][i], :] = unknown
        c[:, y.none[name][j]] = unknown
        out.append((score * scoring.WEIGHTS["date" if name == "day" else name])[c])
    return tuple(out)


def _sexes(x: tuple, y: tuple) -> np.ndarray:
    """sex_score of codes (sex, detected sex) of both sides; where one is unknown, the other alone."""
    known = [(a >= 0) & (b >= 0) for a, b in zip(x, y)]
    same = [(a == b).astype(np.float64) for a, b in zip(x, y)]
    one = np.where(known[0], same[0], np.where(known[1], same[1], scoring.NEUTRAL))
    return np.where(known[0] & known[1], (same[0] + same[1]) / 2, one)


def _reach(age: tuple, low: np.ndarray, high: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The best weighed age score of a group's ages (low, high, any unknown) with groups of such ranges."""
    with np.errstate(invalid="ignore"):
        near = np.nan_to_num(np.maximum(0.0, np.maximum(low - age[1], age[0] - high)), nan=0.0, posinf=np.inf)
    found = _BANDS[_banded(near, [n for n, _ in scoring.BANDS[:-1]])]
    return np.where(none | age[2], np.maximum(found, scoring.NEUTRAL), found) * scoring.WEIGHTS["age"]


def _ranges(r: Records, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    age, none = r.value["age"], r.none["age"]
    odd_ = none | np.isnan(age)
    return np.minimum.reduceat(np.where(odd_, np.inf, age), first), np.maximum.reduceat(np.where(odd_, -np.inf, age), first), np.maximum.reduceat(none, first)


def shortlists(query: DataFrame, gallery: DataFrame, near: DataFrame, q: str, c: str, k: int, sizes: tuple[int, int], min_score: float = 0.0, face_weight: float | None = None) -> DataFrame:
    """query_pos, candidate_pos, similarity, metadata: from each block what can be among the `k` best of each query of two `classed` tables.

    `near` has location_score of each pair of places. With a face_weight all records have plain vectors, and scores are those of face and metadata. Without,
    the groups of a block (one place, the same sexes, a step of years) come by what they can reach at best, and those that can't reach a query's `k`-th score are
    left out. Weighed metadata scores are multiples of 0.005, so rounding to four places is never in doubt there.
    """
    scores = near.select(f"{q}place", f"{c}place", "location_score").collect()  # at most PLACES
    left_places, right_places = ({p: i for i, p in enumerate(sorted({bytes(r[s + "place"]) for r in scores}))} for s in (q, c))
    located = np.zeros((len(left_places), len(right_places)))
    for r in scores:
        located[left_places[bytes(r[0])], right_places[bytes(r[1])]] = scoring.WEIGHTS["location"] * r[2]
    sign = 1 if q == "pm_" else -1
    w = scoring.WEIGHTS
    total_best = w["height"] + w["date"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_pos", pa.int64()), ("candidate_pos", pa.int64()), ("similarity", pa.float64()), ("metadata", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = Records(left, left_places), Records(right, right_places)
        text = [codes(left.column(t), right.column(t)) for t in _TEXTS]

        def grouped(r: Records, sex: tuple, fine: bool):
            keys = (r.pos, r.steps() if fine else np.zeros(len(r.pos), np.int64), *sex, r.place)
            at = np.lexsort(keys)
            change = np.zeros(len(at), bool)
            change[:1] = True
            for v in keys[1:]:
                change[1:] |= np.diff(v[at]) != 0
            r.keep(at)
            first = np.nonzero(change)[0]
            return at, first, np.r_[first[1:], len(at)], tuple(s[at] for s in sex)

        at_x, from_x, to_x, sex_x = grouped(x, (text[0][0], text[1][0]), face_weight is None)
        at_y, from_y, to_y, sex_y = grouped(y, (text[0][1], text[1][1]), True)
        group_sex, group_place, sizes_y = tuple(s[from_y] for s in sex_y), y.place[from_y], to_y - from_y
        age_x, age_y = _ranges(x, from_x, to_x), _ranges(y, from_y, to_y)
        nth = np.empty(len(y.pos), np.int64)
        nth[np.argsort(y.pos, kind="stable")] = np.arange(len(y.pos))  # ties go by place in the gallery
        faces = [matrix(t.column("embedding"))[at] for t, at in ((left, at_x), (right, at_y))] if face_weight is not None else None
        out = []

        def sums(i, j, sex, place) -> np.ndarray:
            age, height, day = _part_scores(x, y, i, j, sign)
            age += sex[None, :]  # sex first, as addition goes in that order
            age += height
            age += day
            age += place[None, :]
            age *= 1e4
            age += 0.5
            return np.floor(age, out=age)

        for g, (a, b) in enumerate(zip(from_x, to_x)):
            sex = w["sex"] * _sexes(tuple(s[a] for s in sex_x), group_sex)
            place = located[x.place[a], group_place]
            if faces is not None:
                sex, place = np.repeat(sex, sizes_y), np.repeat(place, sizes_y)
                j = np.arange(len(y.pos))
                for lo, hi in tiles(b - a, len(j)):
                    i = slice(a + lo, a + hi)
                    metadata = sums(i, j, sex, place) / 1e4
                    v = face_weight * np.clip((faces[0][i] @ faces[1].T + 1) / 2, 0.0, 1.0) + (1 - face_weight) * metadata
                    if len(j) > k:  # rounding to four places makes ties of what lies that near
                        u, z = np.nonzero(v >= np.partition(v, len(j) - k, axis=1)[:, len(j) - k][:, None] - 1.001e-4)
                    else:
                        u, z = map(np.ravel, np.indices(v.shape))
                    out.append((x.pos[i][u], y.pos[z], in_order(faces[0][i], faces[1], u, z), metadata[u, z]))
                continue
            able = np.floor((sex + _reach(tuple(v[g] for v in age_x), *age_y) + total_best + place) * 1e4 + 0.5 + UNSURE)
            order = np.argsort(-able, kind="stable")
            order = order[able[order] >= min_score * 1e4 - UNSURE]
            rows = np.cumsum(sizes_y[order])
            for lo in range(a, b, 512):
                i = slice(lo, min(b, lo + 512))
                n, done, wanted, some = i.stop - lo, 0, FIRST, None
                least = np.full(n, -1, np.int64)
                while done < len(order):
                    end = max(done + 1, int(np.searchsorted(rows, (rows[done - 1] if done else 0) + wanted, "right")))
                    end = min(end, len(order), done + int(np.count_nonzero(able[order[done:]] >= least.min() >> 40)))
                    if end <= done:
                        break
                    these = order[done:end]
                    count = sizes_y[these]
                    j = np.repeat(from_y[these] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    of_sex, of_place = np.repeat(sex[these], count), np.repeat(place[these], count)
                    for s in range(0, len(j), max(1, TILE // n)):
                        e = min(len(j), s + max(1, TILE // n))
                        score = sums(i, j[s:e], of_sex[s:e], of_place[s:e])
                        value = (score.astype(np.int64) << 40) + ((1 << 40) - 1 - nth[j[s:e]])[None, :]
                        if min_score > 0:
                            value[score / 1e4 < min_score] = -1
                        if e - s > k and least.min() < 0:
                            u, z = np.nonzero(value >= np.maximum(least, np.partition(value, e - s - k, axis=1)[:, e - s - k])[:, None])
                        else:
                            u, z = np.nonzero(value > least[:, None])
                        more = (u, value[u, z], j[s:e][z])
                        some = more if some is None else tuple(map(np.concatenate, zip(some, more)))
                        if len(some[0]):
                            kept = best(some[0], (-some[1],), k)
                            some = tuple(v[kept] for v in some)
                            full = np.bincount(some[0], minlength=n) >= k
                            low = np.full(n, np.iinfo(np.int64).max)
                            np.minimum.at(low, some[0], some[1])
                            least = np.where(full, low, -1)
                    done, wanted = end, 2 * wanted
                if some is not None:
                    u, value, z = (v[some[1] >= 0] for v in some)
                    out.append((x.pos[i][u], y.pos[z], np.full(len(u), np.nan), (value >> 40) / 1e4))
        if not out:
            return schema.empty_table()
        p, d, s, m = map(np.concatenate, zip(*out))
        return pa.table([pa.array(p), pa.array(d), pa.array(s, from_pandas=faces is None), pa.array(m)], schema=schema)

    def slim(d: DataFrame, s: str) -> DataFrame:
        own = [F.col(s + n).cast("double").alias(n) for n in ("age", "height_cm")]
        vectors = [F.col(f"{s}embedding").alias("embedding")] if face_weight is not None else []
        return d.select(F.col(f"{s}pos").cast("long").alias("pos"), F.col(f"{s}event_day").alias("event_day"), *own, *[F.col(s + t).alias(t) for t in _TEXTS], F.col(f"{s}place").alias("place"), F.col(f"{s}class").alias("class"), *vectors)

    left, right = slim(query, q), slim(gallery, c).drop("class")
    part, block = (PART, BLOCK) if face_weight is not None else (SLIM_PART, SLIM_BLOCK)
    largest = left.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    salts = -(-largest // max(1, part // 4)) or 1  # one class may hold all queries
    dealt = (F.col("class"), F.pmod(F.xxhash64("pos"), F.lit(salts)))
    return meet(left, right, run, "query_pos long, candidate_pos long, similarity double, metadata double", sizes, part, block, dealt)


def faces_of(found: DataFrame, face_weight: float) -> DataFrame:
    """`shortlists` with vectors, with the final score as `scored` makes it."""
    return found.withColumn("final_score", F.round(scoring.fusion_score(scoring.face_score(F.col("similarity")), F.col("metadata"), face_weight), 4))
