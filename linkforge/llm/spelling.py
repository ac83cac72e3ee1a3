"""Spelling variants by a symmetric-delete join.

1. Words are counted over all texts, with a partial count in each task, so that from there on a word is one row.
2. Every word emits itself and its distinct single deletions. Words one insertion, deletion or replacement apart share exactly one of
   these keys: the shorter word, or the string that both are after losing the place in which they differ. An equi-join on the keys proposes pairs and
   the exact distance verifies them inside the join. The words of a key are that key with one character more, or itself: at most one for each
   place and letter of the alphabet, whatever the corpus.
3. Each word's near words are counted and the commonest becomes its form, if it is `RATIO` times as common as the word.
4. Roots: forms are followed by joining roots to their own roots, which doubles the steps of each round. Counts grow by `RATIO` with each
   step, so there is no circle and no chain longer than the logarithm of the corpus.

Null text has no words. A null doc_id is written as the empty string. Rows that repeat count again. An empty table, or one without a word common enough,
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of a word, at least, and how much commoner its form has to be.
CHARS, TIMES, RATIO = 6, 5, 5


def without(word: Column, at: Column) -> Column:
    """`word` without its code point at `at`, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def slipped(doc_id: Column, word: Column, one_in: int) -> Column:
    """The word as it stands, but in one of `one_in` pairs of document and word without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return F.when(h % one_in == 0, without(word, (h % F.char_length(word)).cast("int"))).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = CHARS, times: int = TIMES, slips: int | None = None) -> DataFrame:
    """word, n of the lower-cased runs of letters that are long and common enough; `slips` drops letters now and then, as careless writers do."""
    # a shorter run can't become long enough, and a greedy match from the left is the maximal run
    runs = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"[{LETTERS}]{{{chars},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.explode(runs).alias("w")).select("d", F.translate("w", UPPER, LOWER).alias("w"))
    word = F.col("w") if slips is None else slipped(F.col("d"), F.col("w"), slips)
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= times) & (F.char_length("word") >= chars))


def keys(word: Column) -> Column:
    """The word itself and its distinct single deletions."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(0), F.char_length(word) - 1), lambda i: without(word, i))))


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: every word beside every other one at distance one, in both directions, each once."""
    rows = words.select("word", "n", F.explode(keys(F.col("word"))).alias("key"))
    a, b = rows.select("key", "word"), rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    return a.join(b, (a["key"] == b["key"]) & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form, from (word, form)."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = cut(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n)."""
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))  # the commonest, then the first in code-point order
    met = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = cut(words.join(met, "word", "left").withColumn("far", -F.col("best.less") >= F.col("n") * ratio))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("far"), F.col("best.form")).alias("form"), F.when(F.col("far"), -F.col("best.less")).alias("form_n"))
    known = roots(formed.where("form is not null"))
    return formed.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int | None = None) -> DataFrame:
    """`variants` of the words of all texts."""
    return variants(word_counts(docs, doc_id, text, slips=slips))
