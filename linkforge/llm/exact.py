"""Exact duplicates by content-defined chunk recipes.

1. Each text is cut where its own characters say so (a word's last two letters, or a mark that ends a passage), between `SHORTEST` and
   `LONGEST` characters, so that an edit moves the cuts near it alone. A text's recipe is the ordered list of its chunks' digests.
2. Chunks are deduplicated: one row a task of each (digest, content) crosses one exchange, and a digest that stands for several
   contents is found by comparing the contents themselves. Such contents are numbered, and recipes that hold one carry the numbers. So an
   identifier, digest and number, is verified to stand for one content.
3. Recipes, not texts, are grouped and joined: a long document crosses the cluster as its distinct chunks, once, and then as 16 bytes a chunk.

Rows that agree in doc_id and recipe are counted where they are read; a hot text is one row a task from there on.
Equal texts form a group. The row of the largest doc_id stays, one alone if several share it; a null doc_id is smaller than
every number and stays only in a group without one. Null text is empty; all empty texts are one group. An empty table gives no rows.
Text that is not valid UTF-8 is one chunk as it stands. Other columns are not read. Everything runs on built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, fresh

#: Characters of a chunk, but for a text's last.
SHORTEST, LONGEST = 256, 4096
#: Rows that one array stands for when counted rows are given back one by one.
BLOCK = 4096


def _every(step: int, rest: int) -> str:
    return "".join(chr(c) for c in range(0x21, 0x100) if c % step == rest and (chr(c).isalnum()))


#: Two letters of every eighth and every sixteenth code, then white space; a blank line; an ideographic full stop.
PLACE = rf"(?:[{_every(8, 4)}][{_every(16, 5)}{_every(16, 14)}]\s|\n\n|。)"
PATTERN = rf"(?s).{{{SHORTEST - 3},{LONGEST - 3}}}?{PLACE}|.{{1,{LONGEST}}}"


def chunks(text: Column) -> Column:
    """The pieces of a text, which spell it; an empty text has none."""
    return F.when(F.is_valid_utf8(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array(text))


def md5(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def _texts(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, sha, chunks, recipe of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), chunks(F.col("text")).alias("chunks"))
    hex_ = F.array_join(F.transform("chunks", lambda c: F.hex(digest(c))), "")
    return rows.withColumn("recipe", F.unhex(hex_))


def clashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """digest, chunk of the digests that stand for several contents; none, as a rule."""
    pieces = _texts(docs, doc_id, text, digest).select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    contents = pieces.distinct()
    several = cut(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("digest"))
    return several if several.isEmpty() else contents.join(several, "digest", "left_semi")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """doc_id, sha, recipe, numbers and n, how many rows they stand for. Texts are equal where recipe and numbers are."""
    rows = _texts(docs, doc_id, text, digest)
    counted = rows.groupBy("doc_id", "sha", "recipe").agg(F.count(F.lit(1)).alias("n"))
    several = clashes(docs, doc_id, text, digest)
    if several.columns == ["digest"]:
        return counted.withColumn("numbers", F.lit(""))
    number = F.row_number().over(W.partitionBy("digest").orderBy("chunk"))
    named = several.withColumn("number", number)
    held = rows.select("doc_id", "sha", F.posexplode("chunks").alias("at", "chunk")).withColumn("digest", digest(F.col("chunk"))).join(named, ["digest", "chunk"])
    held = held.groupBy("doc_id", "sha").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("%010d:%d", "at", "number"))), ",").alias("numbers"))
    on = counted["doc_id"].eqNullSafe(held["doc_id"]) & (counted["sha"] == held["sha"])
    return counted.join(held, on, "left").select(counted["doc_id"], counted["sha"], "recipe", "n", F.coalesce("numbers", F.lit("")).alias("numbers"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row."""
    rows = cut(recipes(docs, doc_id, text, digest))
    groups = rows.groupBy("recipe", "numbers").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = cut(groups.where("group_size > 1"))  # materialised, so that a hot recipe's rows can be split in the join
    met = rows.join(groups, ["recipe", "numbers"], "left")
    met = met.withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    met = met.withColumn("block", F.explode(span(F.ceil(F.col("n") / BLOCK).cast("long"))))
    met = met.withColumn("i", F.explode(span(F.least(F.lit(BLOCK).cast("long"), F.col("n") - F.col("block") * BLOCK))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("i") == 0)
    width = F.octet_length(digest(F.lit("")))
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), (F.octet_length("recipe") / width).cast("long").alias("n_chunks"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = md5) -> DataFrame:
    """The rows that stay, columns unchanged. Of rows that agree in doc_id and text one stays, chosen by a hash of its columns."""
    found = exact_duplicates(docs, doc_id, text, digest).where("kept").select("doc_id", "text_sha256")
    own, key, order = fresh(docs, "_d", "_s", "_o")
    rows = docs.withColumn(own, F.col(f"`{doc_id}`").cast("long")).withColumn(key, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))
    kept = rows.join(found, rows[own].eqNullSafe(found["doc_id"]) & (rows[key] == found["text_sha256"]), "left_semi")
    twice = kept.groupBy(own, key).count().where("count > 1").select(F.col(own).alias("d"), F.col(key).alias("s"))
    if twice.isEmpty():
        return kept.drop(own, key)
    same = F.col(own).eqNullSafe(F.col("d")) & (F.col(key) == F.col("s"))
    # rows of one key are dealt by their other columns first, so that no task ranks all of a hot key
    parts = F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]), F.lit(64))
    ranked = kept.join(twice, same, "left_semi").withColumn(order, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    first = W.partitionBy(own, key, parts).orderBy(order)
    ranked = ranked.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    ranked = ranked.withColumn("_k", F.row_number().over(W.partitionBy(own, key).orderBy(order))).where("_k = 1").drop("_k", order)
    return kept.join(twice, same, "left_anti").unionByName(ranked).drop(own, key)
