"""Document fingerprints: a Merkle tree over sections, paragraphs and the clauses in them.

A blank line ends a section, a line feed a paragraph, and white space after punctuation a clause; the cuts
lose no character, so the leaves spell the whole text. Every node's digest is the SHA-256 of its children's
digests. The fingerprint is the root and the tree below it: each section's digest, and in it the leaves' digests
by paragraph (all shortened). Equal roots mean equal texts. Where roots differ, `edits` goes down: sections
by their digests, in those that differ the paragraphs, in those the leaves. Likeness is the Dice coefficient of the leaf sets.

Null text is empty and has the tree of one empty leaf. An empty table gives no rows. Rows with equal doc_id
follow each other in the order of their texts; a null doc_id comes last. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CLAUSE = r"(?<=\p{Punct}\s)"
#: Hexadecimal digits that the fingerprint keeps of a section's and a leaf's digest.
SECTION_DIGITS, LEAF_DIGITS = 16, 10
#: Ranges of doc_id in which neighbours are looked up, at most, and rows of a range, at least.
RANGES, RANGE_ROWS = 1 << 16, 1024
#: Quantiles of doc_id between which ranges are of equal width: 16 groups of 16.
GROUPS = 16


def leaves(text: Column) -> Column:
    """Digests of the clauses, by section and paragraph."""
    return F.transform(F.split(text, r"\n\n"), lambda s: F.transform(F.split(s, r"\n"), lambda p: F.transform(F.split(p, CLAUSE), lambda c: F.sha2(c, 256))))


def section_digests(tree: Column) -> Column:
    node = lambda children: F.sha2(F.array_join(children, ""), 256)
    return F.transform(tree, lambda s: node(F.transform(s, node)))


def fingerprint(tree: Column, sections: Column) -> Column:
    root = F.sha2(F.array_join(sections, ""), 256)
    ends = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF_DIGITS)), ".")
    under = lambda s, d: F.concat_ws("=", F.substring(d, 1, SECTION_DIGITS), F.array_join(F.transform(s, ends), ","))
    return F.concat_ws(":", root, F.array_join(F.zip_with(tree, sections, under), "/"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with column `name`, the fingerprint of `text`; each level is computed once."""
    tree, sections = f"{name}_tree", f"{name}_sections"
    df = df.withColumn(tree, leaves(F.col(text))).withColumn(sections, section_digests(F.col(tree)))
    return df.withColumn(name, fingerprint(F.col(tree), F.col(sections))).drop(tree, sections)


def leaf_set(print_: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(F.substring_index(print_, ":", -1), "[0-9a-f]+=", ""), "[./,]"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the leaves, under 1."""
    x, y = leaf_set(a), leaf_set(b)
    dice = F.size(F.array_intersect(x, y)) * 2.0 / (F.size(x) + F.size(y))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(F.least(dice, F.lit(0.999999)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f(value)` with the value computed once, however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def differing(x: Column, y: Column) -> Column:
    """Places at which two lists of digests differ: (at, removed, added) of each.

    Lists of one size are held against each other place by place; of others all between the common start and the common end differs.
    """
    spot = lambda i, n, m: F.struct(i.cast("int").alias("at"), n.cast("int").alias("removed"), m.cast("int").alias("added"))
    short = F.least(F.size(x), F.size(y))
    alike = lambda v, w: F.coalesce(F.nullif(F.array_position(F.zip_with(v, w, lambda a, b: a.eqNullSafe(b)), False), F.lit(0)) - 1, short)
    each = F.filter(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z, i: F.when(z["x"] != z["y"], spot(i, F.lit(1), F.lit(1)))), lambda e: e.isNotNull())
    ends = F.struct(alike(x, y).alias("start"), alike(F.reverse(x), F.reverse(y)).alias("end"))
    hull = let(ends, lambda e: let(F.least(e["end"], short - e["start"]), lambda end: F.array(spot(e["start"], F.size(x) - e["start"] - end, F.size(y) - e["start"] - end))))
    return F.when(F.size(x) == F.size(y), each).otherwise(hull)


def edits(a: Column, b: Column) -> Column:
    """The branches in which two fingerprints differ, as `section[.paragraph[.leaf]]:removed:added`.

    `removed` children of `a` from that place on stand against `added` ones of `b`. Numbers begin at 0. Equal texts give none.
    """
    named = lambda e, *path: F.concat_ws(":", F.concat_ws(".", *path, e["at"]), e["removed"], e["added"])
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    both = lambda s, f: pair(f(s["x"]), f(s["y"]))

    def level(s: Column, below: Callable[[Column, Column], Column] | None, keys: Callable[[Column], Column], *path: Column) -> Column:
        """The edits of two lists of children; where one child stands against one, those further down."""
        down = lambda e: F.when((e["removed"] == 1) & (e["added"] == 1), below(both(s, lambda v: F.get(v, e["at"])), e["at"])).otherwise(F.array(named(e, *path)))
        found = let(both(s, keys), lambda k: differing(k["x"], k["y"]))
        return F.transform(found, lambda e: named(e, *path)) if below is None else F.flatten(F.transform(found, down))

    own = lambda v: v
    leaves_ = lambda s, *path: let(both(s, lambda v: F.split(v, "[.]")), lambda k: level(k, None, own, *path))
    paragraphs = lambda s, i: let(
        both(s, lambda v: F.split(F.substring_index(v, "=", -1), ",")), lambda k: level(k, lambda t, j: leaves_(t, i, j), own, i)
    )
    sections = both(pair(a, b), lambda f: F.split(F.substring_index(f, ":", -1), "/"))
    return let(sections, lambda k: level(k, paragraphs, lambda v: F.transform(v, lambda x: F.substring_index(x, "=", 1))))


def ranges(rows: DataFrame) -> Column:
    """The number of a row's range of doc_id: ranges rise with doc_id and hold like numbers of rows, outliers or not.

    Quantiles, 256 of them, and then parts of equal width between them.
    """
    n = GROUPS * GROUPS
    s = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], 100 * n).alias("q"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).first()
    points, top = s["q"] or [0] * n, s["top"] or 0
    parts = max(1, min(RANGES, s["n"] // RANGE_ROWS) // n)
    if s["n"] < RANGE_ROWS * n:  # a small table: every so many quantiles
        step = -(-n // max(1, s["n"] // RANGE_ROWS))
        points = [points[k - k % step] for k in range(n)]
    array = lambda x: "array(" + ",".join(f"{v}L" if v > -(1 << 63) else "-9223372036854775807L - 1L" for v in x) + ")"
    heads = F.expr(array(points[::GROUPS]))
    groups = F.expr("array(" + ",".join(array([*points[g : g + GROUPS], (points[g + GROUPS :] or [top])[0]]) for g in range(0, n, GROUPS)) + ")")
    d = F.coalesce("doc_id", F.lit(points[0]).cast("long"))
    place = lambda x, size: F.greatest(F.lit(0), F.size(F.filter(F.slice(x, 1, size), lambda v: v <= d)) - 1)
    g = place(heads, GROUPS)

    def within(group: Column) -> Column:
        def at(k: Column) -> Column:
            low, high = (F.get(group, k + j).cast("double") for j in (0, 1))
            # in doubles, as a difference of longs can overflow; rounding keeps the order
            part = F.floor((d.cast("double") - low) / F.greatest(F.lit(1.0), high - low) * parts)
            return (g * GROUPS + k) * parts + F.least(F.lit(parts - 1), part).cast("int")

        return let(place(group, GROUPS), at)

    return let(F.get(groups, g), within)


def with_next(rows: DataFrame, finish: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """`finish(rows)` with `next`, the struct of `columns` of the row after it in descending doc_id; the last has the first's.

    Rows are dealt into ranges of doc_id. Only the top row of each range, at most `RANGES`, is looked up by another.
    """
    ranged = rows.withColumn("range", ranges(rows))
    order = W.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")
    inside = finish(ranged).withColumn("next", F.lead(F.struct(*columns)).over(order))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("doc_id"))  # at most RANGES rows
    below = tops.withColumn("below", F.coalesce(F.lag("range").over(W.orderBy("range")), F.max("range").over(W.partitionBy())))
    first = W.partitionBy("range").orderBy("text")
    heads = ranged.join(F.broadcast(tops.withColumnRenamed("doc_id", "top")), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = finish(heads.withColumn("k", F.row_number().over(first)).where("k = 1")).select(F.col("range").alias("below"), F.struct(*columns).alias("head"))
    over = below.join(heads, "below").select("range", "head")
    return inside.join(over, "range", "left").withColumn("next", F.coalesce("next", "head")).drop("range", "head")


def fingerprint_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits of every document.

    The edited text has the last half of its code points replaced by as many of the next document's first; `edits` are the
    branches in which the trees of the two differ.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    both = with_next(rows, lambda d: with_fingerprint(d, "text", "fingerprint"), ["text", "fingerprint"])
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    both = with_fingerprint(both.withColumn("edited", edited), "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
        F.array_join(edits(F.col("fingerprint"), F.col("edited_fingerprint")), " ").alias("edits"),
    )
