"""What files there are, without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsheaf.functions.scalars import format_file_size
from rowsheaf.plans.files import list_inputs, plain_path


def _name_and_folder() -> list[Column]:
    parts = F.split("path", "/")
    return [F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder")]


def file_inventory(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """``path, name, folder, size, size_text, modified`` of every file under ``paths`` that isn't empty.

    The content column is pruned, so only the listing is touched. A file that Spark would leave out for its name
    (``_x.csv``) raises, unless ``pattern`` leaves it out as well.
    """
    if not pattern:
        list_inputs(spark, paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (
        reader.load(list(dict.fromkeys(paths)))
        .select("path", "length", "modificationTime")
        .select(
            "path",
            *_name_and_folder(),
            F.col("length").alias("size"),
            format_file_size("length").alias("size_text"),
            F.date_trunc("minute", "modificationTime").alias("modified"),
        )
    )


def numbered_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Inventory with a 1-based ``index`` in the order of the list; a folder's files follow each other by path.

    Empty files are in it, without their time, and a file listed twice is there once. There is no window over the files:
    the driver holds their list anyway.
    """
    files = [plain_path(f) for f in list_inputs(spark, paths)]
    listed = spark.createDataFrame(list(enumerate(files, 1)), "index long, path string")
    found = file_inventory(spark, paths).select("path", "size", "modified").dropDuplicates(["path"])
    size = F.coalesce("size", F.lit(0).cast("long"))
    return listed.join(found, "path", "left").select(
        "index", "path", *_name_and_folder(), size.alias("size"), format_file_size(size).alias("size_text"), "modified"
    )


def total_size(inventory: DataFrame) -> DataFrame:
    """``n_files, total_bytes, size_text`` over the inventory."""
    totals = inventory.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    return totals.withColumn("size_text", format_file_size("total_bytes"))
