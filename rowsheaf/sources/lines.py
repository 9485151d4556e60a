"""Physical-line scan: every line feed ends a row, no field is parsed, bytes are kept as they are unless an encoding is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsheaf.plans.files import estimated_bytes, file_uri, list_inputs, private_session, size_setting, spark_uri
from rowsheaf.plans.numbering import (
    CHUNK,
    CHUNK_BASE,
    FILE_STRIDE,
    KEY,
    PLACE,
    SIZE,
    START_UNIT,
    Ordered,
    broadcast_if,
    order_chunks,
    place_in_task,
    whole,
)
from rowsheaf.sources.charsets import CODING_SETTINGS, SPARK_CHARSETS, WIDE, charset_of, decoded
from rowsheaf.sources.tables import BOM

LINE_END = "\n"
MIN_SPLIT_BYTES = 4 << 20
TASKS_PER_CORE = 2
# Tasks of several scans of one table are told apart by their scan's number times this.
TASKS_PER_SCAN = 1 << 40


def raw_lines(spark: SparkSession, paths: str | list[str], charset: str | None = None) -> DataFrame:
    """One ``value`` per physical line; a carriage return stays in the value.

    Lines are cut at the line feed of ``charset``, but the value is the line's bytes as they are.
    """
    reader = spark.read.option("lineSep", LINE_END)
    if charset:
        reader = reader.option("encoding", charset)
    return reader.text([paths] if isinstance(paths, str) else paths)


def _fixed_splits(spark: SparkSession, files: list[str], split_bytes: int | None = None, packed: bool = False) -> SparkSession:
    """A session like ``spark`` whose scans cut files at a fixed size and give each split a task of its own.

    A scan keeps the settings of the session it was made in, so every pass over the same lines sees the
    same splits even if cores come and go, and a row's place in its task is its place in its split. With ``packed``
    the cuts are the same, but a task gets as many splits as make up the size that they have without ``split_bytes``.
    """
    session = private_session(spark, CODING_SETTINGS)
    largest = size_setting(spark, "spark.sql.files.maxPartitionBytes")
    total = estimated_bytes(raw_lines(spark, files))
    even = total // (spark.sparkContext.defaultParallelism * TASKS_PER_CORE)
    usual = max(min(largest, even), min(MIN_SPLIT_BYTES, largest), START_UNIT) // START_UNIT * START_UNIT
    size = split_bytes or usual
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", str(size + 1))
    if packed:
        session.conf.set("spark.sql.files.maxPartitionNum", str(max(-(-total // usual), 1)))
    else:
        session.conf.unset("spark.sql.files.maxPartitionNum")
    return session


def _placed(lines: DataFrame, scan: int = 0) -> DataFrame:
    lines = lines.select(
        (F.spark_partition_id().cast("long") + F.lit(scan * TASKS_PER_SCAN)).alias("task"),
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block_start"),
        place_in_task().alias("line_no"),
        "value",
    )
    first = (F.col("block_start") == 0) & (F.col("line_no") == 0)
    return lines.select("task", "file", "block_start", "line_no", first.alias("is_header"), "value")


def _decoded_lines(session: SparkSession, files: list[str], encodings: DataFrame) -> DataFrame:
    """Lines of files in several encodings, as text without byte order marks.

    One scan for each kind of line end, three at most: the encodings whose line feed is one byte share a scan, in
    which a row finds its file's encoding by a join with the list of files.
    """
    wide = {r["path"]: r["encoding"] for r in encodings.where(F.col("encoding").isin(*WIDE)).collect()}
    value, raw = F.col("value"), F.col("value").cast("binary")
    scans = []
    narrow = [f for f in files if f not in wide]
    if narrow:
        uris = session.createDataFrame([(f, file_uri(session, f)) for f in narrow], "path string, _uri string")
        known = uris.join(encodings, "path").select("_uri", charset_of(F.col("encoding")).alias("_charset"))
        here = spark_uri(F.col("file")) == F.col("_uri")
        found = _placed(raw_lines(session, narrow)).join(broadcast_if(known, len(narrow)), here, "left")
        charset = F.coalesce("_charset", F.raise_error(F.lit("a file without an encoding")))
        text = F.when(charset == "UTF-8", value).otherwise(decoded(raw, charset))
        scans.append(found.withColumn("value", text).drop("_uri", "_charset"))
    for i, encoding in enumerate(WIDE, 1):
        inside = [f for f in files if wide.get(f) == encoding]
        if inside:
            charset = SPARK_CHARSETS[encoding]
            lines = _placed(raw_lines(session, inside, charset), i)
            # Half a character at an end: the two bytes of the line feed were of two characters.
            torn = F.raise_error(F.concat(F.lit("characters that look like a line end in "), F.col("file")))
            text = F.when(F.octet_length("value") % 2 == 0, decoded(raw, charset)).otherwise(torn)
            text = F.when(F.col("is_header"), F.regexp_replace(text, "^" + BOM, "")).otherwise(text)
            scans.append(lines.withColumn("value", text))
    return reduce(DataFrame.unionByName, scans)


def scan_lines(
    spark: SparkSession, paths: list[str], split_bytes: int | None = None, encodings: DataFrame | None = None
) -> DataFrame:
    """All lines of the files with their place.

    Columns: ``task`` (number of the task, which has one file split), ``file`` and ``block_start`` (that
    split), ``line_no`` (0-based place of the line in it), ``is_header`` (first line of a file), ``value``.
    ``split_bytes``, whole KB, sets the size of a split. With ``encodings``, the ``path, encoding`` of every
    file, lines are cut and decoded by them; without, they are cut at the byte 0x0A and kept as they are.
    """
    files = list_inputs(spark, paths)
    session = _fixed_splits(spark, files, split_bytes)
    return _placed(raw_lines(session, files)) if encodings is None else _decoded_lines(session, files, encodings)


def scan_splits(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """``value`` of all lines with the ``file_key`` and ``block_start`` of their split.

    A split's lines follow each other in one task. A task has several splits if they are small, so that
    tasks don't become more as splits become smaller.
    """
    files = list_inputs(spark, paths)
    lines = raw_lines(_fixed_splits(spark, files, split_bytes, packed=True), files)
    lines = lines.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block_start"), "value")
    return lines.select(file_key().alias("file_key"), "block_start", "value")


def first_data_line() -> Column:
    """0-based place of the first data line of a split."""
    return F.when(F.col("block_start") == 0, 1).otherwise(0)


def file_key() -> Column:
    """A number for ``file``, which is cheaper to group, compare and join than the name."""
    return F.xxhash64("file")


def with_chunk_numbers(splits: DataFrame, files: list[str]) -> DataFrame:
    """``splits`` (with ``file_key`` and ``block_start``) with :data:`CHUNK`: list order, then file order."""
    spark = splits.sparkSession
    listed = [(file_uri(spark, f), i) for i, f in enumerate(files)]
    order = spark.createDataFrame(listed, "file string, file_idx long")
    order = order.select(file_key().alias("file_key"), "file_idx")
    chunk = F.lit(CHUNK_BASE) + F.col("file_idx") * F.lit(FILE_STRIDE) + whole(F.col("block_start"), START_UNIT)
    return splits.join(broadcast_if(order, len(files)), "file_key").withColumn(CHUNK, chunk).drop("file_idx")


def order_lines(
    spark: SparkSession, paths: list[str], measured: bool = True, encodings: DataFrame | None = None
) -> Ordered:
    """The data lines of the files (headers left out) in list order, then file order.

    Two scans of the text in the end: one for the totals of every split, one for the rows. A row whose
    split is not the one its task was seen with raises. ``encodings`` is as in :func:`scan_lines`; sizes are those of UTF-8.
    """
    files = list_inputs(spark, paths)
    place = (F.col("line_no") - first_data_line()).alias(PLACE)
    columns = [F.col("task").alias(KEY), place, file_key().alias("file_key"), "block_start"]
    if measured:
        columns.append((F.octet_length("value") + 1).cast("long").alias(SIZE))
    lines = scan_lines(spark, files, encodings=encodings).where(~F.col("is_header")).select(*columns, "value")
    return order_chunks(lines, measured, ["file_key", "block_start"], lambda splits: with_chunk_numbers(splits, files))


def header_line(spark: SparkSession, path: str, encodings: DataFrame | None = None) -> str | None:
    """First line of the first file of ``path``, ``None`` when it is empty."""
    first = list_inputs(spark, [path])[:1]
    lines = raw_lines(spark, first) if encodings is None else scan_lines(spark, first, encodings=encodings)
    rows = lines.limit(1).select("value").collect()
    return rows[0]["value"] if rows else None


def count_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``total_lines``, ``data_lines`` and ``n_files`` over all non-empty files, each with one header line."""
    per_file = raw_lines(spark, list_inputs(spark, paths)).groupBy("_metadata.file_path").agg(F.count("*").alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("data_lines"),
        F.count(F.lit(1)).alias("n_files"),
    )
