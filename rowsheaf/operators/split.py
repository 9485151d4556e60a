"""Split text files or a table into parts by rows, part count or bytes, with a manifest."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.functions.scalars import clean_filename
from rowsheaf.plans.files import LAYOUTS, materialise, move_files
from rowsheaf.plans.numbering import (
    CHUNK,
    CHUNK_BASE,
    PLACE,
    ROW,
    SIZE,
    Ordered,
    broadcast_if,
    order_rows,
    refuse_names,
    whole,
    with_greedy_parts,
    with_grid_parts,
    with_row_numbers,
)
from rowsheaf.sinks.csv import csv_line, header_text
from rowsheaf.sources.encoding import encoding_profile
from rowsheaf.sources.inventory import file_inventory
from rowsheaf.sources.lines import header_line, order_lines
from rowsheaf.sources.tables import READ_OPTIONS, quoted

# Fixed values
PART_NAME = "%s_%04d.csv"
PREFIX = "split_part"
ROWS_PER_PART = 1_000_000
PART_COUNT = 10
BYTES_PER_PART = 100 * 1024 * 1024

METHODS = ("rows", "count", "bytes")
CUTS = ("grid", "greedy")

# Named files of fewer rows than this share a task.
ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Split:
    """Rows with their 1-based ``part``, and ``part, rows`` of every part, empty ones included.

    A grid of bytes has ``gaps``: a part number without rows is no part there.
    """

    rows: DataFrame
    sizes: DataFrame
    n_parts: int
    total_rows: int
    total_bytes: int | None
    gaps: bool = False


@dataclass(frozen=True)
class SplitResult:
    seconds: float
    manifest: DataFrame  # part, file, rows, bytes (as written, header included)
    path: str
    layout: str  # "files" or "folders"


def assign_parts(ordered: Ordered, by: str, n: int, cut: str = "grid") -> Split:
    """Give every row its part. ``n`` is rows per part, number of parts, or bytes per part.

    By bytes the cuts lie on a fixed grid: a row belongs to the part its first byte falls in, so a
    part exceeds the target by less than one row, and every row finds its part on its own. With ``cut="greedy"`` each
    part is measured from its own first byte and ends with the first row that ends at ``n`` less 1,024 bytes or later; if none
    does up to 1 MiB after ``n`` bytes, the part takes all the rest.
    """
    if by not in METHODS:
        raise ValueError(f"unknown split method: {by}")
    if n < 1:
        raise ValueError("a split needs a positive number")
    if cut not in CUTS or (cut == "greedy" and by != "bytes"):
        raise ValueError(f"unknown cut for a split by {by}: {cut}")
    total = ordered.total_rows
    if by == "bytes":
        if not ordered.measured:
            raise ValueError("rows were ordered without their bytes")
        if cut == "greedy":
            rows, sizes = with_greedy_parts(ordered, n)
            sizes = materialise(sizes, "greedy-sizes")
            return Split(rows, sizes, max(sizes.count(), 1), total, ordered.total_bytes)
        rows, sizes = with_grid_parts(ordered, n)
        return Split(rows, sizes, max(-(-ordered.total_bytes // n), 1), total, ordered.total_bytes, gaps=True)
    per_part = n if by == "rows" else max(-(-total // n), 1)
    n_parts = n if by == "count" else max(-(-total // n), 1)
    part = (whole(F.col(ROW) - 1, per_part) + 1).cast("int")
    left = F.lit(total) - (F.col("part") - 1).cast("long") * F.lit(per_part)
    sizes = ordered.rows.sparkSession.range(1, n_parts + 1).select(F.col("id").cast("int").alias("part"))
    sizes = sizes.withColumn("rows", F.greatest(F.least(left, F.lit(per_part)), F.lit(0)).cast("long"))
    rows = with_row_numbers(ordered).withColumn("part", part).drop(ROW)
    return Split(rows, sizes, n_parts, total, ordered.total_bytes)


def split_lines(
    spark: SparkSession, path: str | list[str], by: str, n: int, cut: str = "grid", encodings: DataFrame | None = None
) -> Split:
    """Split the physical lines of a CSV file; quoted line ends are not recognised. ``encodings`` is as in ``scan_lines``."""
    paths = [path] if isinstance(path, str) else path
    return assign_parts(order_lines(spark, paths, by == "bytes", encodings), by, n, cut)


def split_table(
    df: DataFrame,
    by: str,
    n: int,
    order_by: list[str | Column],
    line: Column | None = None,
    unique: bool = False,
    cut: str = "grid",
) -> Split:
    """Split the rows of ``df`` in the order of ``order_by``; records stay whole.

    By bytes, ``line`` is the text they are measured on; it defaults to the row's CSV text. A column
    called ``part``, or as one of the columns that the numbering adds, raises.
    """
    refuse_names(df, {"part"})
    measure = (csv_line(df) if line is None else line) if by == "bytes" else None
    return assign_parts(order_rows(df, order_by, measure, unique), by, n, cut)


def part_file(prefix: str, part: Column) -> Column:
    return F.format_string(PART_NAME, clean_filename(F.lit(prefix)), part)


def manifest(split: Split, prefix: str = PREFIX, **extra: Column) -> DataFrame:
    """``part, file, rows`` per part, and ``bytes`` if measured; ``extra`` aggregates are added.

    Row counts follow from the totals; the rows are only read for bytes and extras.
    """
    aggregates = [c.alias(k) for k, c in extra.items()]
    if split.total_bytes is not None:
        aggregates.insert(0, F.sum(SIZE).alias("bytes"))
    sizes = split.sizes
    if aggregates:
        sizes = sizes.join(split.rows.groupBy("part").agg(*aggregates), "part", "left")
    if split.total_bytes is not None:
        sizes = sizes.na.fill({"bytes": 0})
    named = sizes.withColumn("file", part_file(prefix, F.col("part")))
    return named.select("part", "file", *[c for c in sizes.columns if c != "part"])


def _dense(per_part: DataFrame) -> DataFrame:
    """Old ``part`` -> ``new_part`` without gaps, on the manifest only (one row per part).

    Parts are counted within blocks first, so that no task sees all of them.
    """
    block = F.floor(F.col("part") / 4096)
    blocked = per_part.select("part", block.alias("block"))
    sizes = sorted(blocked.groupBy("block").count().collect())
    starts, seen = [], 0
    for b, n in sizes:
        starts.append((b, seen))
        seen += n
    start = per_part.sparkSession.createDataFrame(starts, "block long, before long")
    rank = F.row_number().over(Window.partitionBy("block").orderBy("part"))
    return (
        blocked.withColumn("rank", rank)
        .join(F.broadcast(start), "block")
        .select("part", (F.col("before") + F.col("rank")).cast("int").alias("new_part"))
    )


def write_parts(
    split: Split, out: str, header: str | None, prefix: str = PREFIX, value: str = "value", layout: str = "folders"
) -> SplitResult:
    """Write each part as CSV text with the header on top.

    ``"folders"`` writes without a shuffle, each task its own stretch of rows, to
    ``out/part=1/chunk=.../``; the files of a part's folder, taken by path, are the part. ``"files"``, at
    any size, puts one file per part at ``out/prefix_0001.csv``: one shuffle by part, each written by one
    task, and named one by one in the end.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    started = time.monotonic()
    spark = split.rows.sparkSession
    rows, sizes = split.rows.select("part", CHUNK, PLACE, F.col(value).alias("value")), split.sizes
    if split.gaps:
        n_rows, last = sizes.agg(F.count("*"), F.max("part")).first()
        if last not in (None, n_rows):
            # A row longer than the target leaves parts of the grid empty: close the gaps.
            dense = materialise(_dense(sizes), "dense")
            rows, sizes = (
                df.join(broadcast_if(dense, n_rows), "part").withColumn("part", F.col("new_part")).drop("new_part")
                for df in (rows, sizes)
            )
    if header is not None:
        # Before every chunk, so on top of its part.
        top = [F.lit(CHUNK_BASE - 1).alias(CHUNK), F.lit(0).cast("long").alias(PLACE), F.lit(header).alias("value")]
        rows = rows.unionByName(sizes.select("part", *top))
    if layout == "files":
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(split.n_parts, max(-(-split.total_rows // ROWS_PER_TASK), least))
        task = whole((F.col("part") - 1).cast("long") * F.lit(tasks), split.n_parts).cast("int")
        placed = rows.repartitionById(tasks, task).sortWithinPartitions("part", CHUNK, PLACE)
        staged = f"{out.rstrip('/')}/_parts"
        placed.select("part", "value").write.partitionBy("part").option("lineSep", "\n").text(staged)
        name = spark.range(1).select(clean_filename(F.lit(prefix))).first()[0]
        move_files(spark, staged, out, lambda part: PART_NAME % (name, int(part)))
    else:
        placed = rows.sortWithinPartitions("part", CHUNK, PLACE)
        written = placed.select("part", F.col(CHUNK).alias("chunk"), "value").write
        written.partitionBy("part", "chunk").option("lineSep", "\n").text(out)
    return SplitResult(time.monotonic() - started, _written(sizes, rows, out, prefix, layout), out, layout)


def _written(sizes: DataFrame, rows: DataFrame, out: str, prefix: str, layout: str) -> DataFrame:
    """``part, file, rows, bytes`` of what was written, header included.

    Named files are listed. Folders may be too many for that: their bytes are summed when asked for.
    """
    if layout == "files":
        number = F.regexp_extract("name", r"_(\d+)\.csv$", 1).cast("int")
        listed = file_inventory(rows.sparkSession, [out])
        per_part = listed.groupBy(number.alias("part")).agg(F.sum("size").alias("bytes"))
    else:
        per_part = rows.groupBy("part").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    named = sizes.withColumn("file", part_file(prefix, F.col("part")))
    return named.join(per_part, "part", "left").select("part", "file", "rows", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def split_file(
    spark: SparkSession,
    path: str,
    out: str,
    by: str,
    n: int,
    prefix: str = PREFIX,
    layout: str = "folders",
    cut: str = "grid",
    detect_encoding: bool = False,
) -> SplitResult:
    """Split one CSV file by lines into parts that each start with its header.

    Parts have the bytes of the input, or, with ``detect_encoding``, are UTF-8 whatever the input is in, and measured so.
    """
    encodings = encoding_profile(spark, [path]) if detect_encoding else None
    split = split_lines(spark, path, by, n, cut, encodings)
    return write_parts(split, out, header_line(spark, path, encodings), prefix, layout=layout)


def split_table_to_csv(
    df: DataFrame,
    out: str,
    by: str,
    n: int,
    order_by: list[str | Column],
    prefix: str = PREFIX,
    layout: str = "folders",
    unique: bool = False,
    cut: str = "grid",
) -> SplitResult:
    """Split a table into CSV parts; a record with quoted line ends is never cut."""
    # The line says all about a row; beside it only the order's own columns have to be staged.
    if all(isinstance(k, str) for k in order_by):
        # under names that clash with none
        lines = df.select(*[quoted(c).alias(f"_by_{i}") for i, c in enumerate(order_by)], csv_line(df).alias("_line"))
        order_by = lines.columns[:-1]
    else:
        lines = df.withColumn("_line", csv_line(df))
    split = split_table(lines, by, n, order_by, F.col("_line"), unique, cut)
    return write_parts(split, out, header_text(df.columns), prefix, value="_line", layout=layout)


def read_parts(spark: SparkSession, out: str, schema: T.StructType, prefix: str = PREFIX) -> DataFrame:
    """``file``, the part's name, and the rows of a table that was split to ``folders``, with quoted line ends.

    A file in a part's folder is a stretch of its rows, so no task reads more than one task has written, however large
    the part. Headers have files of their own, which aren't opened.
    """
    plain = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(schema)])
    # the line end is named, as a file's first record may have others inside quotes
    reader = spark.read.options(**READ_OPTIONS | {"sep": ",", "header": "false", "multiLine": "true", "lineSep": "\n", "mode": "FAILFAST"})
    rows = reader.schema(plain).csv(out).where(F.col("chunk") >= CHUNK_BASE)
    return rows.select(part_file(prefix, F.col("part")).alias("file"), *(F.col(f"_c{i}").alias(f.name) for i, f in enumerate(schema)))
