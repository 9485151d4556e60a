"""Which encoding a file is in, and reading it as UTF-8.

The test is a cascade: byte order mark, then the first strict decoding that fits. It runs over the
whole of every file, line by line. Cutting at line feeds is safe in the tried encodings: in none of
them is 0x0A part of a longer character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.plans.files import file_uri, list_inputs, materialise, spark_uri
from rowsheaf.sources.charsets import SPARK_CHARSETS, coding_session, fits
from rowsheaf.sources.lines import raw_lines
from rowsheaf.sources.tables import scan_csv

# Fixed values
BOM_ENCODINGS = [("fffe", "utf-16-le"), ("feff", "utf-16-be")]
UTF8_BOM_BYTES = 3
STRICT_ENCODINGS = ["utf-8", "gbk", "gb18030", "latin-1"]

COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
# A bit for each but the last, in their order.
UTF8_BIT, GBK_BIT, GB18030_BIT = 1, 2, 4


def encoding_profile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, encoding`` of every file, by one pass over all files and one row per file after it.

    A line says which encodings it fits, as the bits of a number; a file's are those that all its lines have. Lines of
    ASCII fit all, so that only the others are decoded.
    """
    files = list_inputs(spark, paths)
    session = coding_session(spark)
    uri = spark_uri(F.col("_metadata.file_path")).alias("uri")
    raw = F.col("value").cast("binary")
    head = F.lower(F.hex(F.substring(raw, 1, 3)))
    marked = F.lit(None).cast("string")
    for mark, encoding in reversed(BOM_ENCODINGS):
        marked = F.when(head.startswith(mark), encoding).otherwise(marked)
    utf8 = F.is_valid_utf8("value")
    ascii_only = utf8 & (F.octet_length("value") == F.char_length("value"))
    # What fits GBK also fits GB18030.
    gb = F.when(fits(raw, "GBK"), GBK_BIT | GB18030_BIT).when(fits(raw, "GB18030"), GB18030_BIT).otherwise(0)
    bits = F.when(utf8, UTF8_BIT).otherwise(0).bitwiseOR(gb)
    lines = raw_lines(session, files).select(
        uri,
        F.when(ascii_only, UTF8_BIT | GBK_BIT | GB18030_BIT).otherwise(bits).alias("bits"),
        (F.octet_length("value") + F.lit(1)).cast("long").alias("n_bytes"),
        F.col("_metadata.file_size").alias("size"),
        # A mark counts only at the very start of a file: the first line of its first split.
        F.when(F.col("_metadata.file_block_start") == 0, marked).alias("mark"),
        F.monotonically_increasing_id().alias("pos"),
        (F.col("_metadata.file_block_start") == 0).alias("first_split"),
    )
    first = lines.groupBy("uri").agg(
        F.bit_and("bits").alias("bits"),
        (F.max("size") - F.sum("n_bytes")).alias("unread"),
        F.min(F.when(F.col("first_split"), F.struct("pos", "mark"))).alias("top"),
    )
    # The line reader skips a UTF-8 mark, so it shows as bytes of the file no line accounts for; a last
    # line without its end counts one byte too many.
    plain = ~F.col("path").rlike(COMPRESSED)
    skipped_mark = plain & F.col("unread").isin(UTF8_BOM_BYTES, UTF8_BOM_BYTES - 1)
    found = F.when(skipped_mark, "utf-8-sig").when(F.col("top.mark").isNotNull(), F.col("top.mark"))
    # An empty file has no line to judge by; it counts as UTF-8.
    found = found.when(F.col("bits").isNull(), STRICT_ENCODINGS[0])
    for i, encoding in enumerate(STRICT_ENCODINGS[:-1]):
        found = found.when(F.col("bits").bitwiseAND(1 << i) != 0, encoding)
    listed = session.createDataFrame([(f, file_uri(spark, f)) for f in files], "path string, uri string")
    encoding = found.otherwise(STRICT_ENCODINGS[-1])  # accepts every byte
    return materialise(listed.join(first, "uri", "left").select("path", encoding.alias("encoding")), "encodings")


def scan_encoded(
    spark: SparkSession, groups: dict[str, list[str]], schema: T.StructType, sep: str = ",", header: bool = True
) -> DataFrame:
    """CSV files of several encodings as one table, one read per encoding; bytes that fit none become U+FFFD."""
    reads = [
        scan_csv(spark, files, schema, sep=sep, header=header, encoding=SPARK_CHARSETS.get(encoding, encoding))
        for encoding, files in groups.items()
    ]
    return reduce(DataFrame.unionByName, reads)


def group_by_encoding(profile: DataFrame) -> dict[str, list[str]]:
    """Profile as ``encoding -> files`` for :func:`scan_encoded`; the driver lists these files anyway."""
    groups: dict[str, list[str]] = {}
    for row in profile.orderBy("path").collect():
        groups.setdefault(row["encoding"], []).append(row["path"])
    return groups
