r"""Chat formatting by quotation linking.

Lines that start with `>` are quoted, one level for each mark. Runs of lines of one level form passages;
a passage is normalised (lower case, white space collapsed) and hashed. Own words of a message are indexed
whole, by passage and by line; the first message of the conversation that wrote a hash is its original.
A message answers the original of its first outermost quotation that has one, whole passages before
single lines. Following these links to the top gives the thread, and conversations are put in
the order of their threads' first messages, own words alone.

Null text has no words and no quotation. Rows with equal (conv_id, turn) share their links and follow each other
in the order of their roles and texts; rows without a conv_id are one conversation, a null turn comes first and links
to nothing. A quotation whose original is not found stays without a link. An empty table gives no rows. Of a conversation
with more than `LONG` messages the places are counted in blocks, by thread, step, turn,
role and the texts' first characters; one task orders only what agrees in all of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Messages up to which a conversation is ordered as a whole, and turns or steps of a thread in one block of a longer one.
LONG, BLOCK = 4096, 4096
#: Characters of a text by which the rows of one turn of a long conversation are told apart before they are ordered, and then four times as many.
PREFIX = 8


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, r"^((?:\s*>)*)", 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """conv, turn, m, line, level, words, passage: a row for each line; passages are numbered in a message."""
    split = messages.select("conv", "turn", "m", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    split = split.select("conv", "turn", "m", "line", level(F.col("raw")).alias("level"), F.regexp_replace("raw", r"^(?:\s*>)+ ?", "").alias("words"))
    w = W.partitionBy("conv", "turn", "m").orderBy("line")
    turned = split.withColumn("new", F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1)))
    return turned.withColumn("passage", F.sum("new").over(w)).drop("new")


def joined(lines: DataFrame, *keys: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: x["words"])
    return lines.groupBy(*keys).agg(F.array_join(parts, "\n").alias("words"), F.min("line").alias("line"))


def linked_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, own_text, reply_to, root_turn, depth, n_quotes, n_linked, position of every message."""
    base = messages.select(
        F.col(f"`{conv_id}`").cast("string").alias("conv"), F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").cast("string").alias("text")
    ).withColumn("m", F.xxhash64("role", "text"))
    base = base.withColumn("conv", F.coalesce(F.concat(F.lit("c"), "conv"), F.lit("")))
    has = F.coalesce(F.col("text").rlike(r"(?m)^\s*>"), F.lit(False))
    quoting = base.where(has)
    lines = cut(lines_of(quoting.dropDuplicates(["conv", "turn", "m"])))
    own = joined(lines.where("level = 0"), "conv", "turn", "m").select("conv", "turn", "m", F.col("words").alias("own"))
    plain = base.where(~has)
    key = lambda c: F.xxhash64(normal(c))
    # only conversations with a quotation can link, so only their words are indexed
    some = quoting.select("conv").distinct()
    said = plain.join(some, "conv", "left_semi").select("conv", "turn", F.explode(F.concat(F.array("text"), F.split("text", "\n"))).alias("words"))
    said = said.unionByName(lines.where("level = 0").select("conv", "turn", "words"))
    said = said.unionByName(joined(lines.where("level = 0"), "conv", "turn", "m", "passage").select("conv", "turn", "words"))
    index = said.where(F.char_length(normal(F.col("words"))) > 0).groupBy("conv", key(F.col("words")).alias("h")).agg(F.min("turn").alias("original"))
    quoted = lines.where("level > 0")
    whole = joined(quoted, "conv", "turn", "m", "passage", "level").withColumn("rank", F.lit(0))
    each = quoted.select("conv", "turn", "m", "passage", "level", "words", "line").withColumn("rank", F.lit(1))
    asked = whole.unionByName(each).where(F.char_length(normal(F.col("words"))) > 0).withColumn("h", key(F.col("words")))
    met = asked.join(index, ["conv", "h"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    # one original for each passage, then the message's first outermost one
    passages = met.groupBy("conv", "turn", "m", "passage", "level").agg(F.min(F.when(F.col("original").isNotNull(), F.struct("rank", "line", "original")))["original"].alias("original"), F.min("line").alias("line"))
    replies = passages.groupBy("conv", "turn", "m").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"), F.min(F.when(F.col("original").isNotNull(), F.struct("level", "line", "original")))["original"].alias("reply_to")
    )
    replies = cut(replies)
    links = replies.where("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("reply_to"))
    roots = follow(links)
    quoted_rows = quoting.join(own, ["conv", "turn", "m"], "left").join(replies, ["conv", "turn", "m"], "left").select(
        "conv", "conv_id", "turn", "role", "text", F.coalesce("own", F.lit("")).alias("own_text"), "reply_to", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )
    none = F.lit(0).cast("long")
    plain_rows = plain.select("conv", "conv_id", "turn", "role", "text", F.col("text").alias("own_text"), F.lit(None).cast("long").alias("reply_to"), none.alias("n_quotes"), none.alias("n_linked"))
    # a row for each linked message: it never grows beyond the links
    rows = quoted_rows.join(roots, ["conv", "turn"], "left").unionByName(plain_rows, allowMissingColumns=True)
    rows = rows.withColumns({"root_turn": F.coalesce("root", "turn"), "depth": F.coalesce("steps", F.lit(0)).cast("long")})
    long = base.groupBy("conv").agg(F.count(F.lit(1)).alias("messages")).where(F.col("messages") > LONG).select("conv")
    plain_order = W.partitionBy("conv").orderBy("root_turn", "depth", "turn", "role", "text")
    short = rows.join(long, "conv", "left_anti").withColumn("position", F.row_number().over(plain_order) - 1)
    placed = short.unionByName(in_blocks(rows.join(long, "conv", "left_semi")))
    return placed.select("conv_id", "turn", "role", "own_text", "reply_to", "root_turn", "depth", "n_quotes", "n_linked", F.col("position").cast("long"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """`rows` with `position` in their conversation by root_turn, depth, turn, role and text.

    Blocks of roots, of steps below one root, of turns at one step, of one turn's roles, and of texts by their first characters follow each other; each is
    counted first, and the counts before it are summed level by level. What one task still orders are the rows of a turn and role whose texts begin alike.
    """
    block = lambda c: F.coalesce(F.floor(F.col(c) / BLOCK), F.lit(-1)).cast("long")
    own = F.coalesce("root_turn", F.lit(-1))
    d = rows.withColumns({"b0": block("root_turn"), "b1": own, "b2": block("depth"), "b3": F.col("depth"), "b4": block("turn")})
    known = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit(""))  # noqa: E731  null first, as in the order
    d = d.withColumns({"b5": F.coalesce("turn", F.lit(-1)), "b6": known(F.col("role")), "b7": known(F.substring("text", 1, PREFIX)), "b8": known(F.substring("text", 1, 4 * PREFIX))})
    levels = [["b0"], ["b1", "b2"], ["b3", "b4"], ["b5", "b6"], ["b7"], ["b8"]]
    keys, start = ["conv"], None
    sizes = d.groupBy("conv", *[x for level in levels for x in level]).agg(F.count(F.lit(1)).alias("k"))
    for level in levels:
        before = W.partitionBy(*keys).orderBy(*level).rowsBetween(W.unboundedPreceding, -1)
        counted = sizes.groupBy(*keys, *level).agg(F.sum("k").alias("k")).withColumn("ahead", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
        start = counted if start is None else counted.join(start, keys).withColumn("ahead", F.col("ahead") + F.col("first")).drop("first")
        keys = keys + level
        start = start.withColumnRenamed("ahead", "first")
    last = W.partitionBy(*keys).orderBy("text")
    return d.withColumn("own_place", F.row_number().over(last)).join(start, keys).withColumn("position", F.col("first") + F.col("own_place") - 1).drop(*keys[1:], "own_place", "first")


def follow(links: DataFrame) -> DataFrame:
    """conv, turn, root, steps: the top of each chain of replies, by doubling the stride of every link until none goes on; replies go back in turns, so it ends."""
    at = cut(links.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("steps")))
    while True:
        on = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        far = at.join(on, ["conv", "root"], "left")
        if far.where("next is not null").isEmpty():
            return at
        at = cut(far.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
