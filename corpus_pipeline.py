"""From raw documents to packed training sequences: language, near copies, repeats, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import langid, mixing, ngram_join, packing, suffix
from linkforge.llm.common import documents, drop_tables, table, tables_made
from linkforge.llm.queries import TOKENIZER, held_out


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language learned, go."""
    model = langid.fit(docs.where(~held_out()))
    return langid.known_languages(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier are taken out of the texts; n_chars follows."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: Tokenisation, suffix sorting and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), tables_made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
            drop_tables(spark, mark)  # what the stage kept for itself, and its input
    return docs
