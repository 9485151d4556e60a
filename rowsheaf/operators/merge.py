"""Merge many CSV files into one data set, by position: the first file's header names the columns."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.plans.files import (
    comparable_uri,
    estimated_bytes,
    file_uri,
    hadoop_path,
    list_inputs,
    plain_path,
    size_setting,
    stored_bytes,
)
from rowsheaf.plans.numbering import BROADCAST_ROWS, CHUNK, CHUNK_BASE, ROW, place_in_task, with_row_numbers
from rowsheaf.sinks.csv import write_csv
from rowsheaf.sources.charsets import SPARK_CHARSETS
from rowsheaf.sources.encoding import encoding_profile, group_by_encoding, scan_encoded
from rowsheaf.sources.lines import (
    file_key,
    first_data_line,
    header_line,
    order_lines,
    raw_lines,
    scan_lines,
    with_chunk_numbers,
)
from rowsheaf.sources.tables import header_names, scan_csv, text_schema

HEADERS = ("each", "first", "none")


@dataclass(frozen=True)
class MergeResult:
    seconds: float
    input_bytes: int
    output_bytes: int
    path: str

    @property
    def mb_per_second(self) -> float:
        return self.input_bytes / (1024 * 1024) / self.seconds if self.seconds else 0.0


def merge_tables(
    spark: SparkSession,
    paths: list[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    header: bool = True,
    detect_encoding: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """All rows of the files as one table, columns matched by position.

    One scan, no shuffle, no order promise. A row with another number of fields than the first
    file's header raises; :func:`merge_lines` takes such files as they are. With ``detect_encoding``
    each encoding found is read with its own decoder.
    """
    files = list_inputs(spark, paths)
    groups = group_by_encoding(encoding_profile(spark, files)) if detect_encoding else None
    if schema is None:
        first = next((e for e, fs in (groups or {}).items() if files[0] in fs), None)
        schema = text_schema(header_names(spark, files[0], sep, SPARK_CHARSETS.get(first, first), multi_line))
    if groups is None:
        return scan_csv(spark, files, schema, sep=sep, header=header, multi_line=multi_line)
    return scan_encoded(spark, groups, schema, sep=sep, header=header)


def merge_lines(spark: SparkSession, paths: list[str], detect_encoding: bool = False) -> DataFrame:
    """All lines of the files but their headers, with their place in the input order.

    Byte for byte, cut at 0x0A, or, with ``detect_encoding``, cut and decoded by the encoding found for each file.
    """
    return _data_lines(spark, paths, encoding_profile(spark, paths) if detect_encoding else None)


def _data_lines(spark: SparkSession, paths: list[str], encodings: DataFrame | None) -> DataFrame:
    return scan_lines(spark, paths, encodings=encodings).where(~F.col("is_header"))


def merge_ordered(spark: SparkSession, paths: list[str], detect_encoding: bool = False) -> DataFrame:
    """``row_no, value``: the data lines with their global number, list order, then file order."""
    encodings = encoding_profile(spark, paths) if detect_encoding else None
    rows = with_row_numbers(order_lines(spark, paths, measured=False, encodings=encodings))
    return rows.select(F.col(ROW).alias("row_no"), "value")


def merge_manifest(spark: SparkSession, paths: list[str], detect_encoding: bool = False) -> DataFrame:
    """``file_idx, folder, name, rows, bytes`` per input file, header line not counted; bytes are those of the merged lines."""
    listed = list_inputs(spark, paths)
    per_file = merge_lines(spark, listed, detect_encoding).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes")
    )
    named = [(i, file_uri(spark, f), plain_path(f)) for i, f in enumerate(listed)]
    files = spark.createDataFrame(named, "file_idx long, file string, path string")
    parts = F.split("path", "/")
    return files.join(per_file, "file", "left").select(
        "file_idx",
        F.element_at(parts, -2).alias("folder"),
        F.element_at(parts, -1).alias("name"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )


def _refuse_own_input(spark: SparkSession, files: list[str], out: str) -> None:
    fs, p = hadoop_path(spark, out)
    target = comparable_uri(fs.makeQualified(p).toUri().toString()).rstrip("/")
    if any(f == target or f.startswith(target + "/") for f in (file_uri(spark, f) for f in files)):
        raise ValueError(f"output {out} holds input files")


def write_merged_lines(
    spark: SparkSession,
    paths: list[str],
    out: str,
    header: str = "each",
    ordered: bool = True,
    compact: bool = False,
    detect_encoding: bool = False,
) -> MergeResult:
    """Merge line by line into a folder whose files, taken by path, are in input order.

    Map-only: each file split is written by the task that reads it, under a ``chunk=`` folder named
    by file and split, so order costs neither a shuffle nor a sort. Without ``ordered`` there are no
    such folders, and no order. With ``compact``, for many small files, lines are brought together by a
    range shuffle over their places into ordered files of the usual size. ``header="each"`` starts every
    file with the first input's header, so that the folder reads as CSV; ``"first"`` has it once, so that
    the concatenated files are the merged file; ``"none"`` drops it. With ``detect_encoding`` the output is UTF-8, whatever
    each input is in; without, bytes are kept, and files in UTF-16 must not be given.
    """
    if header not in HEADERS:
        raise ValueError(f"unknown header mode: {header}")
    started = time.monotonic()
    files = list_inputs(spark, paths)
    _refuse_own_input(spark, files, out)
    encodings = encoding_profile(spark, files) if detect_encoding else None
    head = header_line(spark, files[0], encodings) if header != "none" else None
    rows = _data_lines(spark, files, encodings)
    # The first data line of a split; one split is one output file.
    first = F.col("line_no") == first_data_line()
    if ordered or compact:
        rows = with_chunk_numbers(rows.withColumn("file_key", file_key()), files)
    else:
        rows = rows.withColumn(CHUNK, F.lit(CHUNK_BASE))
    if compact:
        size = size_setting(spark, "spark.sql.files.maxPartitionBytes")
        full_files = -(-estimated_bytes(raw_lines(spark, files)) // size)
        place = [CHUNK, "line_no"]
        rows = rows.repartitionByRange(max(full_files, 1), *place).sortWithinPartitions(*place)
        first = place_in_task() == 0
    value = F.col("value")
    if head is not None and header == "each":
        value = F.when(first, F.concat(F.lit(head + "\n"), value)).otherwise(value)
    rows = rows.select(CHUNK, "line_no", value.alias("value"))
    session = rows.sparkSession  # the scan's own
    top = session.createDataFrame([(CHUNK_BASE - 1, 0, head)], f"{CHUNK} long, line_no long, value string").coalesce(1)
    if header == "first" and head is not None:
        rows = top.unionByName(rows)
    if ordered and not compact:
        if len(files) <= BROADCAST_ROWS:
            # A task has one split, which is one chunk: with a file kept open the writer sorts nothing.
            session.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")
        else:
            rows = rows.sortWithinPartitions(CHUNK, "line_no")
        rows.select(F.col(CHUNK).alias("chunk"), "value").write.partitionBy("chunk").option("lineSep", "\n").text(out)
    else:
        rows.select("value").write.option("lineSep", "\n").text(out)
    if header == "each" and head is not None and stored_bytes(spark, out) == 0:
        # Without a data line no file had a first line to put the header on.
        top.select("value").write.mode("overwrite").option("lineSep", "\n").text(out)
    return _merge_result(spark, files, out, started)


def write_merged_table(spark: SparkSession, paths: list[str], out: str, header: bool = True, **options) -> MergeResult:
    """:func:`merge_tables` into a folder of UTF-8 CSV files, each with the header if it is kept."""
    started = time.monotonic()
    files = list_inputs(spark, paths)
    _refuse_own_input(spark, files, out)
    write_csv(merge_tables(spark, files, **options), out, header=header)
    return _merge_result(spark, files, out, started)


def _merge_result(spark: SparkSession, files: list[str], out: str, started: float) -> MergeResult:
    seconds = time.monotonic() - started
    return MergeResult(seconds, estimated_bytes(raw_lines(spark, files)), stored_bytes(spark, out), out)
