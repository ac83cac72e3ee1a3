"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, fingerprints, langid, media, mixing, ngram_join, packing, quality, runs, sharding, spelling, sql, suffix
from .common import documents

TOKENIZER = "word_bpe_49k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_conversations(documents(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where messages quote earlier ones: every conversation of the table, with quotations put in."""
    return chat.linked_conversations(spark.sql(sql.QUOTING, conversations=documents(spark, sf_dir, "conversations")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is certain of the mix before the draw: sizes and targets."""
    mixed = mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each vector of `embeddings` is drawn as one."""
    return media.image_copies(media.pictures(documents(spark, sf_dir, "embeddings")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(documents(spark, sf_dir), echo=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), slips=199)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir)).drop("n_chunks")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_best_fit_packing,
        op3_document_fingerprints,
        op4_mix_sources,
        op5_chat_formatting,
        op6_sharding,
        op7_language_id,
        op8_ngram_jaccard_join,
        op9_media_copies,
        op10_suffix_array_dedup,
        op11_periodic_runs,
        op12_spelling_variants,
        op13_exact_dedup,
        quoted_conversations,
        mix_targets,
    )
}

ORACLES: dict[str, str] = {
    "op5_chat_formatting": sql.chat("conversations"),
    "quoted_conversations": sql.chat("(" + sql.QUOTING.format(conversations="conversations") + ")"),
    "mix_targets": sql.MIX_TARGETS,
    "op3_document_fingerprints": sql.FINGERPRINTS,
    "op8_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op10_suffix_array_dedup": sql.SUFFIX_ARRAY,
    "op11_periodic_runs": sql.PERIODIC_RUNS,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
    "op13_exact_dedup": sql.EXACT,
}
