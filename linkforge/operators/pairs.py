"""Pairs of two registries: normal forms first, then one scored projection over a cross join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scoring, vector
from ..functions.location import canonical_province, location_score, location_tokens, with_profile
from ..functions.text import normalize_text
from ..shared import table
from . import blocks

#: Bytes up to which the smaller registry is broadcast; beyond, both sides are joined in blocks.
BROADCAST_BYTES = 128 << 20
#: Nearest vectors up to which a first stage is made in blocks.
KEEP = 1024


def prepare(records: DataFrame, normalize: Callable[[Column], Column] = normalize_text) -> DataFrame:
    """Everything that a score needs of one record, computed once for it."""
    d = with_profile(records, normalize)
    low = lambda c: F.nullif(F.lower(F.col(c)), F.lit(""))
    return d.select(
        "record_id", "pos", low("sex").alias("sex"), low("detected_sex").alias("detected_sex"), scoring.age_middle(F.col("age_min"), F.col("age_max")).alias("age"), "height_cm", "event_day",
        "n_location", "n_province", "n_district", "n_municipality", "tokens", "canon", "embedding",
    )


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def bytes_of(df: DataFrame) -> int:
    """About the bytes that the rows take in memory, by one aggregate over their columns."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        own = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.array_join(c, "  ")) if kind == "array<string>" else F.size(c) * 8 if kind.startswith("array") else F.lit(0)
        size = size + 16 + F.greatest(F.lit(0), F.coalesce(own, F.lit(0)))
    return df.agg(F.sum(size)).first()[0] or 0


def cross(large: DataFrame, small: DataFrame, condition: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Cross join by broadcasting `small` if it takes at most `most` bytes, else by a block-wise product.

    The large side is spread over the cores first: one small file would be a single task.
    """
    cores = large.sparkSession.sparkContext.defaultParallelism
    if bytes_of(small) <= most:
        spread = large.repartition(cores)
        return spread.join(F.broadcast(small), condition if condition is not None else F.lit(True))
    out = large.crossJoin(small)
    return out.where(condition) if condition is not None else out


def scored(pairs: DataFrame, face_weight: float = scoring.FACE_WEIGHT, face: bool = True) -> DataFrame:
    """Pair columns with the component scores, similarity, metadata_score, face_score, final_score and conflicts.

    The final score blends the unrounded face score with the rounded metadata score.
    """
    d = pairs.withColumns(scoring.components())
    d = d.withColumn("metadata_score", scoring.metadata_score())
    both = F.col("am_embedding").isNotNull() & F.col("pm_embedding").isNotNull()
    similarity = F.when(both, vector.dot(F.col("am_embedding"), F.col("pm_embedding"))) if face else F.lit(None).cast("double")
    d = d.withColumn("similarity", similarity)
    raw = scoring.face_score(F.col("similarity"))
    raw = F.when(F.col("similarity").isNotNull(), raw)
    return d.withColumns(
        {"final_score": F.round(scoring.fusion_score(raw, F.col("metadata_score"), face_weight), 4), "face_score": F.round(raw, 4), **scoring.conflicts()}
    )


def ranked(rows: DataFrame, k: int, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """Top `k` of each query: rank from 1 by rounded final score, raw similarity, then gallery order."""
    order = order or [F.desc("final_score"), F.desc_nulls_last("similarity"), F.asc("candidate_pos")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= max(1, k))


def narrow(pairs: DataFrame, q: str, c: str) -> DataFrame:
    """What a ranking needs of a pair: the rest is joined back for the few pairs that stay."""
    return pairs.select(F.col(f"{q}pos").alias("query_pos"), F.col(f"{c}pos").alias("candidate_pos"), "final_score", *[x for x in ("similarity",) if x in pairs.columns])


def rejoined(top: DataFrame, query: DataFrame, gallery: DataFrame, q: str, c: str) -> DataFrame:
    """Both records of each ranked pair, by their positions, which are unique in a registry."""
    kept = top.select("query_pos", "candidate_pos", "rank")
    return kept.join(query, F.col("query_pos") == F.col(f"{q}pos")).join(gallery, F.col("candidate_pos") == F.col(f"{c}pos"))


# ------------------------------------------------------------------ metadata, by bounds

OTHER = {"am": "pm", "pm": "am"}
PLACE = ("n_location", "n_province", "n_district", "n_municipality")
AGE_STEP = 5
#: Records for each one asked for among which a query's first guess is made.
FIRST = 5
RANGES = ("age", "height_cm", "event_day")
SCORED = ("pos", "sex", "detected_sex", *RANGES, *PLACE)


def _name(*columns: Column) -> Column:
    """128 bits for what the columns hold."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))


def classed(records: DataFrame, s: str) -> DataFrame:
    """Records with the names of their place, their block (place and sexes) and their class (block and step of `AGE_STEP` years)."""
    age = F.col(f"{s}age")
    step = F.when(F.abs(age) < 1000, F.floor(age / AGE_STEP).cast("long"))
    d = records.withColumn(f"{s}place", _name(*[F.col(s + x) for x in PLACE]))
    d = d.withColumn(f"{s}block", _name(*[F.col(s + x) for x in ("place", "sex", "detected_sex")]))
    return d.withColumn(f"{s}class", _name(F.col(f"{s}block"), step.alias("step"), F.isnan(age).alias("nan")))


def classes(gallery: DataFrame, c: str) -> DataFrame:
    """A row for each class of the gallery: its block, place and sexes, the number of its records, and the ranges of what they don't share.

    Where a record lacks a value, or has one that is no number, the class's floor is what that scores.
    """
    far, zero = F.lit(1e300), F.lit(0.0)

    def ranges(x: str) -> list[Column]:
        v = F.col(f"{c}{x}")
        floor = F.when(F.count(v) < F.count(F.lit(1)), scoring.NEUTRAL).otherwise(zero).alias(f"{x}_floor")
        if x == "event_day":
            return [F.min(v).alias(f"{x}_low"), F.max(v).alias(f"{x}_high"), floor]
        odd = F.isnan(F.max(v))
        return [F.when(odd, -far).otherwise(F.coalesce(F.min(v), far)).alias(f"{x}_low"), F.coalesce(F.when(~odd, F.max(v)), far).alias(f"{x}_high"), floor]

    return gallery.groupBy(*[c + x for x in ("class", "block", "place", "sex", "detected_sex")]).agg(F.count(F.lit(1)).alias("n"), *[y for x in RANGES for y in ranges(x)])


def places(query: DataFrame, gallery: DataFrame, q: str, c: str) -> DataFrame:
    """location_score of each place of the queries with each place of the gallery."""

    def own(d: DataFrame, s: str) -> DataFrame:
        d = d.select(f"{s}place", *[s + x for x in PLACE]).distinct()
        return d.withColumns({f"{s}tokens": location_tokens(F.col(f"{s}n_location")), f"{s}canon": canonical_province(F.coalesce(f"{s}n_province", f"{s}n_location"))})

    return own(query, q).crossJoin(own(gallery, c)).select(f"{q}place", f"{c}place", location_score().alias("location_score"))


def bounds(pairs: DataFrame, q: str) -> DataFrame:
    """Queries beside classes, with `most`: no record of the class scores higher with the query. The same sums and rounding as the score's make that exact."""
    value, low, high = F.col(f"{q}event_day"), F.col("event_day_low"), F.col("event_day_high")
    least, most = (F.datediff(value, high), F.datediff(value, low)) if q == "pm_" else (F.datediff(low, value), F.datediff(high, value))
    near = {f"{x}_near": F.greatest(F.lit(0.0), F.col(f"{x}_low") - F.col(q + x), F.col(q + x) - F.col(f"{x}_high")) for x in RANGES[:2]}
    near["day_near"] = F.when(most < 0, most).otherwise(F.greatest(F.lit(0), least))  # the smallest gap that is no less than 0 scores best
    out = pairs.withColumns(near)
    band = lambda x, score: F.when(F.col(q + x).isNull(), scoring.NEUTRAL).otherwise(F.greatest(score, F.col(f"{x}_floor")))
    out = out.withColumns({
        "age_score": band("age", scoring.band_score(F.col("age_near"))),
        "height_score": band("height_cm", scoring.band_score(F.col("height_cm_near"))),
        "date_score": band("event_day", F.when(low.isNotNull(), scoring.date_bands(F.col("day_near")))),
    })
    return out.withColumn("most", scoring.metadata_score())


def reaching(pairs: DataFrame, least: Column) -> DataFrame:
    """The rows whose `most` is no less than `least`. As a generator, since a filter would be pushed down and compute every bound once more."""
    return pairs.select("query_pos", "class", "location_score", F.explode(F.when(F.col("most") >= least, F.array("most"))).alias("most"))


def metadata_scores(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(scoring.components()).withColumn("final_score", scoring.metadata_score())


def bounded(query: DataFrame, gallery: DataFrame, q: str, c: str, k: int, min_score: float = 0.0, found: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """query_pos, candidate_pos, final_score, rank of the top `k` of two `classed` tables by metadata; pairs that can't be among them are never made.

    For each query the `k` best classes (one place, the same sexes, a step of years) among those of the nearest places, of `FIRST * k` records or a place
    more, are scored. The `k`-th score is what any record has to reach: blocks (place and sexes) that can't are dropped, then classes, by their ranges of
    age, height and day; the rest is scored. Where records hardly share classes, more than half as many classes as records, a bound would cost what a score
    costs, and every pair is scored; the result is the same. What is under `min_score` is dropped outright. `found` sees the pairs that are scored.
    """
    spread = max(query.sparkSession.sparkContext.defaultParallelism, int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = lambda d, s: d.select(*[s + x for x in (*SCORED, "place", "block", "class")])
    query, gallery = slim(query, q), slim(gallery, c)
    near, groups = table(places(query, gallery, q, c)), table(classes(gallery, c))
    sizes = groups.groupBy(f"{c}place").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy(f"{q}place").orderBy(F.desc("location_score"), F.asc(f"{c}place")).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    nearest = near.join(sizes, f"{c}place").withColumn("before", before).where(F.col("before") < FIRST * k).drop("n", "before")
    blocks = groups.groupBy(*[c + x for x in ("block", "place", "sex", "detected_sex")]).count().drop("count")
    rest_best = {f"{x}_score": F.lit(1.0) for x in ("age", "height", "date")}

    def blocked(queries: DataFrame, near: DataFrame) -> DataFrame:
        """Each query beside each block, which fixes its scores by place and sex; `able` is what its records could score at best."""
        d = queries.repartition(spread, f"{q}pos").join(near, f"{q}place").join(blocks, f"{c}place").withColumn("sex_score", scoring.sex_score())
        return d.withColumns(rest_best).withColumn("able", scoring.metadata_score()).drop(*rest_best)

    def bounded_classes(chosen: DataFrame) -> DataFrame:
        return bounds(chosen.join(groups.drop(*[c + x for x in ("place", "sex", "detected_sex")], "n"), f"{c}block"), q).withColumnsRenamed({f"{q}pos": "query_pos", f"{c}class": "class"})

    def members(chosen: DataFrame) -> DataFrame:
        return chosen.select("query_pos", F.col("class").alias(f"{c}class"), "location_score").join(gallery, f"{c}class").join(query, F.col("query_pos") == F.col(f"{q}pos"))

    def best(pairs: DataFrame) -> DataFrame:
        own = {x: f for x, f in scoring.components().items() if x != "location_score"}
        d = found(pairs).withColumns(own).withColumn("final_score", scoring.metadata_score()).where(F.col("final_score") >= min_score)
        return ranked(narrow(d, q, c), k, ["query_pos"], [F.desc("final_score"), F.asc("candidate_pos")])

    n = groups.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("records")).first()
    if 2 * n["classes"] > (n["records"] or 0):
        return best(query.repartition(spread, f"{q}pos").join(near, f"{q}place").join(gallery, f"{c}place"))
    start = reaching(bounded_classes(blocked(query, nearest).where(F.col("able") >= min_score)), F.lit(min_score))
    nth = F.row_number().over(W.partitionBy("query_pos").orderBy(F.desc("most"), F.asc("class")))
    first = best(members(table(start.withColumn("nth", nth).where(F.col("nth") <= k))))
    last = table(first.where(F.col("rank") == k).select(F.col("query_pos").alias(f"{q}pos"), F.col("final_score").alias("last")))
    again = query.join(last, f"{q}pos", "left").withColumn("last", F.coalesce("last", F.lit(min_score)))
    return best(members(table(reaching(bounded_classes(blocked(again, near).where(F.col("able") >= F.col("last"))), F.col("last")))))


def by_metadata(query: DataFrame, gallery: DataFrame, q: str, c: str, k: int, min_score: float = 0.0, found: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What `bounded` gives; beyond `blocks.PAIRS` pairs in blocks, unless `found` is to see the pairs or places are as many as records."""
    if found is not None:
        return bounded(query, gallery, q, c, k, min_score, found)
    sizes = query.count(), gallery.count()
    if sizes[0] * sizes[1] > blocks.PAIRS and (near := near_places(query, gallery, q, c)) is not None:
        d = blocks.shortlists(query, gallery, near, q, c, k, sizes, min_score)
        return ranked(d.select("query_pos", "candidate_pos", F.col("metadata").alias("final_score")), k, ["query_pos"], [F.desc("final_score"), F.asc("candidate_pos")])
    return bounded(query, gallery, q, c, k, min_score)


def near_places(query: DataFrame, gallery: DataFrame, q: str, c: str) -> DataFrame | None:
    """`places`, if they are at most `blocks.PLACES` pairs."""
    n = [d.select(f"{s}place").distinct().count() for d, s in ((query, q), (gallery, c))]
    return table(places(query, gallery, q, c)) if n[0] * n[1] <= blocks.PLACES else None


def metadata_search(am: DataFrame, pm: DataFrame, k: int = 10, min_score: float = 0.0, found: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """PM to AM by metadata alone over the whole gallery."""
    a, p = table(classed(prefixed(am.drop("embedding"), "am_"), "am_")), table(classed(prefixed(pm.drop("embedding"), "pm_"), "pm_"))
    top = by_metadata(p, a, "pm_", "am_", max(1, k), min_score, found)
    return metadata_scores(rejoined(top, p, a, "pm_", "am_")).select("pm_record_id", "am_record_id", "rank", "final_score", *scoring.COMPONENTS)


def near_metadata(am: DataFrame, pm: DataFrame, k: int) -> DataFrame | None:
    """pm_pos, am_pos of pairs with all that are among the `k` best of a PM record by metadata: the best of each block. None for small registries, of which all pairs can be made, and where places are as many as records."""
    a, p = (table(classed(prefixed(d.drop("embedding"), s), s)) for d, s in ((am, "am_"), (pm, "pm_")))
    sizes = p.count(), a.count()
    near = near_places(p, a, "pm_", "am_") if sizes[0] * sizes[1] > blocks.PAIRS else None
    if near is None:
        return None
    return blocks.shortlists(p, a, near, "pm_", "am_", k, sizes).select(F.col("query_pos").alias("pm_pos"), F.col("candidate_pos").alias("am_pos"))


# ----------------------------------------------------------------- faces and metadata


def face_pairs(a: DataFrame, p: DataFrame, sides: tuple[str, ...], k: int, keep: dict[str, int], limited: bool, face_weight: float) -> DataFrame:
    """query_type, query_pos, candidate_pos, rank among the pairs of two vectors, each scored once for all sides.

    Where they are `limited`, a side's queries keep their `keep` nearest vectors for the ranking.
    """
    d = scored(cross(a.where("am_embedding is not null"), p.where("pm_embedding is not null")), face_weight)
    places = [F.struct(F.lit(q).alias("query_type"), F.col(f"{q}_pos").alias("query_pos"), F.col(f"{OTHER[q]}_pos").alias("candidate_pos")) for q in sides]
    d = d.select(F.explode(F.array(*places)).alias("x") if len(sides) > 1 else places[0].alias("x"), "final_score", "similarity").select("x.*", "final_score", "similarity")
    by = ["query_type", "query_pos"]
    if limited:
        near = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("similarity"), F.asc("candidate_pos")))
        d = d.withColumn("near", near).where(F.col("near") <= max(keep.values()))  # a literal, so that each task keeps as many before the shuffle
        if len(set(keep.values())) > 1:
            d = d.where(F.col("near") <= F.when(F.col("query_type") == sides[0], keep[sides[0]]).otherwise(keep[sides[-1]]))
        d = d.drop("near")
    return ranked(d, k, by)


def face_blocks(query: DataFrame, gallery: DataFrame, near: DataFrame, q: str, c: str, k: int, keep: int | None, face_weight: float) -> DataFrame:
    """query_pos, candidate_pos, rank of the top `k` among the pairs of two vectors, in blocks; with `keep`, only that many nearest vectors are ranked."""
    size = blocks.size_of((query, f"{q}embedding"), (gallery, f"{c}embedding"))
    plain, other = (tuple(d.where(x if odd else ~x) for d, x in ((d, blocks.odd(F.col(f"{s}embedding"), size)) for d, s in ((query, q), (gallery, c)))) for odd in (False, True))
    sizes = tuple(d.count() for d in plain)
    rest = [cross(gallery, other[0]), cross(plain[0], other[1])] if any(not d.isEmpty() for d in other) else []
    names = [F.col(f"{q}pos").alias("query_pos"), F.col(f"{c}pos").alias("candidate_pos")]
    if keep is None:
        d = blocks.faces_of(blocks.shortlists(*plain, near, q, c, k, sizes, face_weight=face_weight), face_weight).select("query_pos", "candidate_pos", "final_score", "similarity")
        for x in rest:
            d = d.unionByName(scored(x, face_weight).select(*names, "final_score", "similarity"))
        return ranked(d, k, ["query_pos"]).select("query_pos", "candidate_pos", "rank")
    slim = lambda d, s, pos, v: d.select(F.col(f"{s}pos").alias(pos), F.col(f"{s}embedding").alias(v))
    d = blocks.nearest(slim(plain[0], q, "query", "q"), slim(plain[1], c, "candidate", "x"), keep, sizes).withColumnsRenamed({"query": "query_pos", "candidate": "candidate_pos"})
    for x in rest:
        d = d.unionByName(x.select(*names, vector.dot(F.col("am_embedding"), F.col("pm_embedding")).alias("similarity")))
    d = ranked(d, keep, ["query_pos"], [F.desc("similarity"), F.asc("candidate_pos")])
    return ranked(narrow(scored(rejoined(d, query, gallery, q, c), face_weight), q, c), k, ["query_pos"]).select("query_pos", "candidate_pos", "rank")


def search(am: DataFrame, pm: DataFrame, query_type: str, k: int = 20, first_stage: int | str | None = "all", face_weight: float = scoring.FACE_WEIGHT) -> DataFrame:
    """Top `k` of the other registry for every record of `query_type`: `am`, `pm`, or `both` for either direction.

    A query with a vector ranks candidates with one only, if there are any; one without ranks all by metadata, within bounds.
    With a first stage smaller than the gallery, only its nearest vectors are ranked. In both directions a pair of vectors is scored once.
    """
    k = max(1, k)
    sides = ("am", "pm") if query_type == "both" else (query_type,)
    rows = {"am": table(classed(prefixed(am, "am_"), "am_")), "pm": table(classed(prefixed(pm, "pm_"), "pm_"))}
    with_vector = {s: rows[s].where(f"{s}_embedding is not null") for s in ("am", "pm")}
    vectors = {s: d.count() for s, d in with_vector.items()}
    faced = vectors["am"] > 0 and vectors["pm"] > 0
    top = None
    if faced:
        keep = {q: vector.first_stage_k(first_stage, vectors[OTHER[q]]) for q in sides}
        limited = [q for q, n in keep.items() if n < vectors[OTHER[q]]]
        near = near_places(with_vector["am"], with_vector["pm"], "am_", "pm_") if vectors["am"] * vectors["pm"] > blocks.PAIRS and all(keep[q] <= KEEP for q in limited) else None
        if near is None:
            top = face_pairs(rows["am"], rows["pm"], sides, k, keep, bool(limited), face_weight).select("query_type", "query_pos", "candidate_pos", "rank")
        else:
            each = [face_blocks(with_vector[q], with_vector[OTHER[q]], near, f"{q}_", f"{OTHER[q]}_", k, keep[q] if q in limited else None, face_weight).withColumn("query_type", F.lit(q)) for q in sides]
            top = reduce(DataFrame.unionByName, each)
    for q in sides:
        query = rows[q].where(f"{q}_embedding is null") if faced else rows[q]
        one = by_metadata(query, rows[OTHER[q]], f"{q}_", f"{OTHER[q]}_", k).select(F.lit(q).alias("query_type"), "query_pos", "candidate_pos", "rank")
        top = one if top is None else top.unionByName(one)
    # the rows of the shorter table last, so that wide rows stay where they are
    q_am = F.col("query_type") == "am"
    place = {"am": F.when(q_am, F.col("query_pos")).otherwise(F.col("candidate_pos")), "pm": F.when(q_am, F.col("candidate_pos")).otherwise(F.col("query_pos"))}
    full, bytes_ = top.select("*", *[x.alias(f"{s}_place_of") for s, x in place.items()]), {s: bytes_of(d) for s, d in rows.items()}
    for s in sorted(rows, key=lambda s: -bytes_[s]):
        own = F.broadcast(rows[s]) if bytes_[s] <= BROADCAST_BYTES and bytes_[s] < max(bytes_.values()) else rows[s]
        full = full.join(own, F.col(f"{s}_place_of") == F.col(f"{s}_pos"))
    is_am = F.col("query_type") == "am"
    am_id, pm_id = F.col("am_record_id"), F.col("pm_record_id")
    return scored(full, face_weight).select(
        "query_type", F.when(is_am, am_id).otherwise(pm_id).alias("query_record_id"), F.when(is_am, "pm").otherwise("am").alias("candidate_type"), F.when(is_am, pm_id).otherwise(am_id).alias("candidate_record_id"), "rank",
        "face_score", "metadata_score", "final_score", *scoring.COMPONENTS, *scoring.CONFLICTS, F.when(F.col("similarity").isNotNull(), "face+metadata").otherwise("metadata_only").alias("candidate_source"),
    )


def transient(query: DataFrame, gallery: DataFrame, target: str, k: int = 20) -> DataFrame:
    """An ad-hoc query (absent fields are unknown) against the registry `target`, as `search` ranks it."""
    k = max(1, min(100, k))
    side = {"am": "pm", "pm": "am"}[target]
    return search(query if side == "am" else gallery, gallery if side == "am" else query, side, k)


def vector_topk(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Nearest `k` by exact inner product: query_id, candidate_id, rank, similarity."""
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    c = gallery.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("x"))
    plain, rest = met(q, c)
    scan = lambda d: d.withColumn("similarity", vector.dot(F.col("q"), F.col("x"))).drop("q", "x")
    found = [blocks.nearest(*plain, k, tuple(d.count() for d in plain))] if plain else []
    d = reduce(DataFrame.unionByName, [*found, *map(scan, rest)]).withColumnsRenamed({"query": "query_id", "candidate": "candidate_id"})
    return ranked(d, k, ["query_id"], [F.desc("similarity"), F.asc("candidate_id")])


def met(q: DataFrame, c: DataFrame) -> tuple[tuple[DataFrame, DataFrame] | None, list[DataFrame]]:
    """The sides (query, q) and (candidate, x) whose pairs are made in blocks, if they are beyond `blocks.PAIRS`, and all other pairs as cross joins."""
    if q.count() * c.count() <= blocks.PAIRS or any(dict(d.dtypes)[x] not in ("int", "bigint") for d, x in ((q, "query"), (c, "candidate"))):
        return None, [cross(q, c)]
    size = blocks.size_of((q, "q"), (c, "x"))
    (q_plain, q_odd), (c_plain, c_odd) = ([d.where(~blocks.odd(F.col(x), size)), d.where(blocks.odd(F.col(x), size))] for d, x in ((q, "q"), (c, "x")))
    return (q_plain, c_plain), [*([] if q_odd.isEmpty() else [cross(c, q_odd)]), *([] if c_odd.isEmpty() else [cross(q_plain, c_odd)])]


def max_per_group(queries: DataFrame, gallery: DataFrame, places: int) -> DataFrame:
    """query, group, similarity: the largest product, rounded, of each query with the vectors of each `group` of the gallery."""
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    c = gallery.select(F.col("vec_id").alias("candidate"), "group", F.col("embedding").alias("x"))
    plain, rest = met(q, c)
    found = [blocks.highest(*plain, tuple(d.count() for d in plain))] if plain else []
    d = reduce(DataFrame.unionByName, [*found, *[x.select("query", "group", vector.dot(F.col("q"), F.col("x")).alias("similarity")) for x in rest]])
    return d.groupBy("query", "group").agg(F.round(F.max("similarity"), places).alias("similarity"))


def rank_of_right(queries: DataFrame, gallery: DataFrame, truth: DataFrame, modes: tuple[str, ...], scores: Callable, most: int = 20) -> DataFrame:
    """`truth` (query_id, correct_id) for each mode, with the rank of the right candidate among all; NULL beyond `most`.

    `scores` gives a pair's score by each mode from its rounded face, query and candidate: of columns, and beyond `blocks.PAIRS` pairs of arrays. Scores are
    rounded to four places, ties go by candidate. There only those that stand before the right one are counted, and no pair leaves its block.
    """
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    c = gallery.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("x"))

    def scored_by(d: DataFrame) -> DataFrame:
        z = d.withColumn("face", F.round(scoring.face_score(vector.dot(F.col("q"), F.col("x"))), 4)).drop("q", "x")
        return z.withColumn("scores", F.array(*[F.round(s, 4) for s in scores(F.col("face"), F.col("query"), F.col("candidate"))]))

    plain, rest = met(q, c)
    by_mode = lambda x: F.posexplode(x).alias("m", "x")
    named = truth.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(modes) - 1))))
    mode = F.element_at(F.array(*[F.lit(m) for m in modes]), F.col("m") + 1)
    if plain is None:
        top = ranked(scored_by(rest[0]).select("query", "candidate", by_mode("scores")), most, ["m", "query"], [F.desc("x"), F.asc("candidate")])
        top = top.select("m", F.col("query").alias("query_id"), F.col("candidate").alias("correct_id"), "rank")
        return named.join(top, ["m", "query_id", "correct_id"], "left").withColumn("mode", mode).drop("m")
    right = truth.select(F.col("query_id").alias("query"), F.col("correct_id").alias("right"))
    asked = table(scored_by(right.join(q, "query").join(c.withColumnRenamed("candidate", "right"), "right").withColumn("candidate", F.col("right"))).select("query", "right", "scores"))
    before = [blocks.above(plain[0].join(asked, "query"), plain[1], scores, len(modes), tuple(d.count() for d in plain))]
    for x in rest:
        z = scored_by(x).join(asked.withColumnRenamed("scores", "wanted"), "query")
        earlier = F.zip_with("scores", "wanted", lambda s, w: F.coalesce((s > w) | ((s == w) & (F.col("candidate") < F.col("right"))), F.lit(False)).cast("long"))
        before.append(z.select("query", earlier.alias("above")))
    counted = reduce(DataFrame.unionByName, before).select(F.col("query").alias("query_id"), by_mode("above")).groupBy("query_id", "m").agg((F.sum("x") + 1).alias("rank"))
    return named.join(counted, ["query_id", "m"], "left").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).withColumn("mode", mode).drop("m")
