"""The queries of this package and the SQL they are checked against; ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsheaf.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    nearest,
    ngram_join,
    pii,
    resampling,
    spelling,
)
from rowsheaf.llm.similarity_sql import components_sql
from rowsheaf.llm.text import held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), RANKS, PATTERN, fold=(7, 2))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"), shingle_words=4, threshold=(17, 20))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), RANKS, PATTERN, ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = language_id.train(docs.where("NOT held_out"))
    found = language_id.identify(docs, model, keep=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    nodes = chat_format.conversation_nodes(given.unionByName(hard))
    formatted = chat_format.format_reply_trees(nodes).withColumnRenamed("tree_id", "conv_id")
    return chat_format.read_digests(formatted, ["conv_id"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, threshold=(80, 100))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.corpus_words(_table(spark, sf_dir, "documents"), drop_every=spelling.DROP_EVERY)
    return spelling.variant_groups(words)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_lm_scoring,
        op2_decontamination,
        op3_line_dedup,
        op4_nearest,
        op5_ngram_join,
        op6_byte_bpe,
        op7_language_id,
        op8_license_scan,
        op9_chat_format,
        op10_pii,
        op11_resampling,
        op12_minhash_dedup,
        op13_spelling,
    )
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.spread_sql(),
    "op5_ngram_join": components_sql(4, (17, 20)),
    "op8_license_scan": license_scan.scan_sql(),
    "op11_resampling": resampling.resample_sql(),
    "op12_minhash_dedup": components_sql(4, (80, 100), kept=True),
    "op13_spelling": spelling.variants_sql(),
}
