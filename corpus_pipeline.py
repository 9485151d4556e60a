"""The corpus pipeline: documents through five operators, each stage's rows written and read again by the next.

``STAGES`` lists (name, function). A function takes ``(spark, docs, sf_dir)`` and gives a table; all but the last
give the columns of ``documents``. Null and empty texts have no letter, so the first stage drops them.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsheaf.llm import byte_bpe, decontamination, language_id, line_dedup, ngram_join
from rowsheaf.llm.text import sized
from rowsheaf.plans.files import materialise, release, scratch_dir, scratch_scope, with_row_ids

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# Rows that go to a Python worker at a time, at most: an executor holds a batch of whole texts several times over, outside its heap.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

# The scratch tables of the stage before, by application.
_HELD: dict[str, str] = {}


def _stage(function):
    """A stage whose scratch tables go when the next one starts: by then its rows have been written, as the contract says.

    Its Arrow batches are small, and as its rows are written after it returns, the session keeps that setting.
    """

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, *filter(None, [_HELD.pop(app, None)]))
        rows = int(spark.conf.get(_BATCH_SETTING))
        spark.conf.set(_BATCH_SETTING, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        with scratch_scope(spark, function.__name__) as _HELD[app]:
            return function(spark, docs, sf_dir)

    return staged


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays open. Learns from all rows with a ``lang``."""
    return language_id.accepted(docs, language_id.train(docs)).select(*COLUMNS)


def near_copies(docs: DataFrame, id_col: str = "doc_id", unique_ids: bool = False) -> DataFrame:
    """Documents linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.similar_components(docs, shingle_words=5, threshold=(4, 5), id_col=id_col, unique_ids=unique_ids)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts; ``n_chars`` follows its text. Documents of such lines only, all of which
    stay where they come first, are dropped, and no others.

    Lines that only copies of one document spread over many sources are none: the next stage needs them to find the copies.
    """
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), components=near_copies)
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike("\\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are near copies, keep the one with the smallest id, the first of equals; a null id comes last.

    Rows are told apart by where they stand, so one with a null or repeated id is as good as any other.
    """
    numbered = with_row_ids(docs.select(*COLUMNS), "_row")
    found = near_copies(numbered, "_row", unique_ids=True).select("_row", "component_id")
    several = found.where("component_id != _row").select("component_id").distinct()
    members = found.join(sized(materialise(several, "copies-several")), "component_id", "left_semi")
    members = members.join(numbered.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = members.groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    gone = materialise(members.select("_row").join(sized(materialise(kept, "copies-kept")), "_row", "left_anti"), "copies-gone")
    return numbered.join(sized(gone), "_row", "left_anti").select(*COLUMNS)


@_stage
def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold half of a benchmark item or more, in whatever order. An item too short for a seed of five words
    must itself be half of the row's text, as a word or two in a long text come there by chance."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    numbered = with_row_ids(docs.select(*COLUMNS), "_row")
    found = decontamination.contaminated(numbered, benchmark, id_col="_row")
    tells = (F.col("item_words") >= decontamination.MIN_MATCH) | (2 * F.col("item_words") >= F.col("doc_words"))
    found = found.where(tells).select("_row").distinct()
    return numbered.join(sized(materialise(found, "benchmark-rows")), "_row", "left_anti").select(*COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of them and of what they decode to."""
    return byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("byte_bpe", encode),
]

# Language models, tilings and byte-pair merges can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written under the shared scratch folder and read by the next.

    A stage's table is dropped when the next one's has been written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            release(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
