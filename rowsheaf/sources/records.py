"""CSV records with quoted line ends, read in as many splits as there are.

Whether a line begins inside quotes depends on all the quotes before it, but only on whether their number is even. Each split
says that of its own quotes, one small row each; a prefix over those rows tells every split how it begins. Then each
split puts its lines together to records by itself, and only the pieces of records that go over the end of a split, two
a split at most, are brought together.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.plans.files import list_inputs, materialise
from rowsheaf.plans.numbering import CHUNK, broadcast_if
from rowsheaf.sources.lines import scan_splits, with_chunk_numbers
from rowsheaf.sources.tables import BOM, READ_OPTIONS, infer_types, quoted, text_schema

QUOTE = '"'

_PIECES = f"{CHUNK} long, file_key long, record_no long, is_head boolean, leading boolean, open boolean, value string"


def _pieces(batches):
    """The records of each split, in order: the first is the end of an earlier one if the split begins inside quotes
    (``leading``), and the last goes on in the next if it ends there (``open``)."""
    state, held, place, first = None, None, 0, None

    def rows(values: pa.Array, is_open: bool) -> pa.RecordBatch:
        n, chunk, key, at_start, inside = len(values), *first
        numbers = np.arange(place, place + n)
        leading = (numbers == 0) & inside
        ends = np.zeros(n, bool)
        ends[-1:] = is_open
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), pa.array(np.full(n, key)), pa.array(numbers), pa.array((numbers == 0) & at_start & ~leading), pa.array(leading), pa.array(ends), values],
            [CHUNK, "file_key", "record_no", "is_head", "leading", "open", "value"],
        )

    for batch in batches:
        chunks = batch.column(CHUNK).to_numpy()
        lines = batch.column("value").cast(pa.large_string())
        counts = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if first is None or first[0] != chunks[begin]:
                # the next split of the task
                if held is not None:
                    yield rows(pa.array([held], pa.string()), state == 1)
                chunk, key, start, inside = (batch.column(c)[begin].as_py() for c in (CHUNK, "file_key", "block_start", "inside"))
                first, state, held, place = (chunk, key, start == 0, bool(inside)), int(inside), None, 0
            values, quotes = lines.slice(begin, end - begin), counts[begin:end]
            before = (state + np.cumsum(quotes) - quotes) % 2
            state = int((state + quotes.sum()) % 2)
            starts = np.flatnonzero(before == 0)
            if held is not None and (len(starts) == 0 or starts[0] > 0):
                # the record in hand goes on
                more = values.slice(0, starts[0] if len(starts) else len(values)).to_pylist()
                held = "\n".join([held, *more])
            elif held is None and (len(starts) == 0 or starts[0] > 0):
                held = "\n".join(values.slice(0, starts[0] if len(starts) else len(values)).to_pylist())
            if len(starts):
                lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(values))), values)
                joined = pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.string())
                done = joined.slice(0, len(joined) - 1)
                if held is not None:
                    done = pa.concat_arrays([pa.array([held], pa.string()), done])
                held = joined[len(joined) - 1].as_py()
                if len(done):
                    yield rows(done, False)
                    place += len(done)
    if held is not None:
        yield rows(pa.array([held], pa.string()), state == 1)


def scan_records(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """``value`` (the text of a record, line ends inside quotes kept), ``is_head`` (first of its file), ``chunk`` and
    ``record_no``, which put the records of all files in list order, then file order.

    UTF-8; a quote inside quotes is doubled. A file with a quote that is never closed raises before any record is put together.
    A carriage return before a record's end is dropped, and a byte order mark before a file's first record. Empty lines between
    records are no records.
    """
    files = list_inputs(spark, paths)
    lines = scan_splits(spark, files, split_bytes)
    n_quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    splits = lines.groupBy("file_key", "block_start").agg((F.sum(n_quotes) % 2).alias("odd"))
    splits = materialise(with_chunk_numbers(splits, files), "record-splits")
    unclosed = splits.groupBy("file_key").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").count()
    if unclosed:
        raise ValueError(f"a quote is never closed in {unclosed} of {len(files)} files")
    before = Window.partitionBy("file_key").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    starts = splits.select("file_key", "block_start", CHUNK, inside.alias("inside"))
    found = lines.join(broadcast_if(starts, splits.count()), ["file_key", "block_start"], "left")
    checked = F.when(F.col(CHUNK).isNotNull(), F.col("inside")).otherwise(F.raise_error(F.lit("the input changed between two scans")))
    pieces = found.select(CHUNK, "file_key", "block_start", checked.alias("inside"), "value").mapInArrow(_pieces, _PIECES)
    pieces = materialise(pieces, "record-pieces")

    # the pieces at the seams: each that doesn't lead begins a record, which the leading ones after it go on with
    seams = pieces.where("leading OR open")
    in_order = Window.partitionBy("file_key").orderBy(CHUNK, "record_no")
    seams = seams.withColumn("_record", F.sum(F.when(F.col("leading"), 0).otherwise(1)).over(in_order))
    parts = F.sort_array(F.collect_list(F.struct(CHUNK, "record_no", "is_head", "value"))).alias("parts")
    joined = seams.groupBy("file_key", "_record").agg(parts)
    joined = joined.select(
        F.array_join("parts.value", "\n").alias("value"), F.get("parts", F.lit(0))["is_head"].alias("is_head"),
        F.get("parts", F.lit(0))[CHUNK].alias(CHUNK), F.get("parts", F.lit(0))["record_no"].alias("record_no"),
    )
    records = pieces.where("NOT leading AND NOT open").select("value", "is_head", CHUNK, "record_no").unionByName(joined)
    value = F.regexp_replace("value", "\r\\z", "")
    value = F.when(F.col("is_head"), F.regexp_replace(value, f"^{BOM}", "")).otherwise(value)
    return records.select(value.alias("value"), "is_head", F.col(CHUNK).alias("chunk"), "record_no").where("value != ''")


def scan_csv_records(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    header: bool = True,
    sample_rows: int | None = None,
    split_bytes: int | None = None,
) -> DataFrame:
    """A CSV table whose quoted fields may hold line ends, as :func:`scan_csv` with ``multi_line`` reads it, but split.

    Every file has a header, if any has; names come from the first. Without a schema the types come from all records, or
    the first ``sample_rows``. A record that doesn't fit raises.
    """
    paths = [path] if isinstance(path, str) else path
    records = scan_records(spark, paths, split_bytes)
    if schema is None:
        head = records.where("is_head").orderBy("chunk").select("value").first()
        first = next(csv.reader([head["value"]], delimiter=sep)) if head else []
        names = first if header else [f"_c{i}" for i in range(len(first))]
    if header:
        records = records.where(~F.col("is_head"))

    def parsed(wanted: T.StructType) -> DataFrame:
        options = READ_OPTIONS | {"sep": sep, "mode": "FAILFAST"}
        options.pop("enforceSchema")
        plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(wanted)])
        row = F.from_csv("value", plain.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("row")
        return records.select(row).select(*(F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(wanted)))

    if schema is None:
        schema = infer_types(parsed(text_schema(names)), sample_rows)
    return parsed(schema).select(*(quoted(f.name) for f in schema))
