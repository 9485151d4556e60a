"""Removal of boilerplate lines by the number of distinct sites that have them.

Each line's sites go into a HyperLogLog sketch, merged by its hash. Estimates clearly over or under the threshold
stand; lines near it get exact distinct counts. Lines spread over enough sites are removed from every document
but the first that has them.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.llm.text import BROADCAST_ROWS, sized, slices, trimmed
from rowsheaf.plans.files import materialise

MIN_SITES = 10
# Registers of a sketch as a power of two: 2^12 give a standard error of 1.04 / 64.
LG_REGISTERS = 12
# Standard errors within which an estimate isn't trusted.
SURE = 4


# 96 bits stand for a line; all of them zero for a blank one.
_HASH = np.dtype([("a", "<i8"), ("b", "<i4")])
_BLANK = bytes(_HASH.itemsize)


def _norm(text: str) -> list[str]:
    """The lines of a text. Lines are one if they differ only in case and in runs of blanks."""
    text = text.lower()
    for blank in "\t\r\f\x0b":
        text = text.replace(blank, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return [line.strip(" ") for line in text.split("\n")]


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many lines each text has, and the hashes of all of them."""
    counts, found = [], []
    for text in texts:
        lines = _norm(text)
        counts.append(len(lines))
        found += [blake2b(line.encode(), digest_size=len(_BLANK)).digest() if line else _BLANK for line in lines]
    return np.array(counts, np.int64), np.frombuffer(b"".join(found), _HASH)


def _hashed(df: DataFrame, text_col: str, keep_text: bool = False) -> DataFrame:
    """``df`` with ``_hashes`` of the lines of its texts, null for blank lines, without the texts unless ``keep_text``.

    The lines are made in slices of the texts in the workers: as JVM strings, several for each line, they fill the heap.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    plain = df.toDF(*names)
    kept = [i for i in range(len(names)) if keep_text or i != at]

    def run(batches):
        for batch in batches:
            start = 0
            for part in slices(batch, at):
                counts, flat = _hashes(part.column(at).to_pylist())
                blank = (flat["a"] == 0) & (flat["b"] == 0)
                each = pa.StructArray.from_arrays([pa.array(flat["a"].copy()), pa.array(flat["b"].copy())], ["a", "b"], mask=pa.array(blank))
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                own = batch.slice(start, part.num_rows)
                start += part.num_rows
                columns = [own.column(i) for i in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, each)], [*[names[i] for i in kept], "_hashes"])

    schema = T.StructType([plain.schema.fields[i] for i in kept]).add("_hashes", T.ArrayType(T.StructType().add("a", T.LongType()).add("b", T.IntegerType())))
    return plain.mapInArrow(trimmed(run), schema).toDF(*[df.columns[i] for i in kept], "_hashes")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes ``h`` of the lines (``h``, ``site``) found at ``min_sites`` distinct sites or more. A null site counts for none.

    Sketches are built where the lines are and merged after the shuffle, so a line with very many rows or sites
    costs one sketch per task. Exact counts are taken of the near ones only.
    """
    error = SURE * 1.04 / 2 ** (LG_REGISTERS / 2)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"))
    sketched = sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = int(min_sites * (1 - error)), min_sites * (1 + error)
    sketched = materialise(sketched.where(F.col("sites") >= min(low, min_sites - 1)), "line-sites")
    near = sketched.where(F.col("sites") <= high).select("h")
    exact = lines.join(sized(near), "h", "left_semi").where("site IS NOT NULL").select("h", "site").distinct()
    exact = exact.groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    return materialise(sketched.where(F.col("sites") > high).select("h").unionByName(exact), "line-boilerplate")


def _in_different_texts(found: DataFrame, lines: DataFrame, source: DataFrame, least: int, components: Callable) -> DataFrame:
    """Of the lines ``found``, those in ``least`` texts or more that aren't near copies of each other."""
    held = materialise(lines.join(sized(found), "h", "left_semi").select("h", "key").distinct(), "line-held")
    grouped = components(source.select(F.col("key").alias("doc_id"), "text"))
    grouped = grouped.select(F.col("doc_id").alias("key"), "component_id").distinct()
    counted = held.join(grouped, "key").select("h", "component_id").distinct().groupBy("h").count()
    return materialise(counted.where(F.col("count") >= least).select("h"), "line-different")


def _without(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the lines of ``first`` (``h``, and the id and place ``first`` where it stays) taken out, and ``n_removed``.

    ``first`` goes to every task, and the texts stay where they are.
    """
    rows = first.select("h.a", "h.b", "first._id", "first.place").toPandas().sort_values("a")
    known = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["_id"].tolist(), rows["place"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = docs.toDF(*names)

    def places_gone(ids: list, counts: np.ndarray, flat: np.ndarray) -> dict[int, set]:
        """The places of the lines to take out, by row."""
        a, b, stays_in, stays_at = shared.value
        starts = np.cumsum(counts) - counts
        low, high = np.searchsorted(a, flat["a"]), np.searchsorted(a, flat["a"], side="right")
        gone: dict[int, set] = {}
        for i in np.flatnonzero((high > low) & ((flat["a"] != 0) | (flat["b"] != 0))).tolist():
            row = int(np.searchsorted(starts, i, side="right")) - 1
            place = i - int(starts[row])
            for k in range(low[i], high[i]):
                if b[k] == flat["b"][i] and ids[row] is not None and (ids[row], place) != (stays_in[k], stays_at[k]):
                    gone.setdefault(row, set()).add(place)
        return gone

    def run(batches):
        for batch in batches:
            start = 0
            for part in slices(batch, text_at):
                own = batch.slice(start, part.num_rows)
                start += part.num_rows
                texts, changed = own.column(text_at), part.column(text_at).to_pylist()
                gone = places_gone(own.column(at).to_pylist(), *_hashes(changed))
                n_removed = np.zeros(own.num_rows, np.int64)
                if gone:
                    for row, places in gone.items():
                        n_removed[row] = len(places)
                        changed[row] = "\n".join(line for place, line in enumerate(changed[row].split("\n")) if place not in places)
                    texts = pa.array(changed, texts.type, mask=texts.is_null().to_numpy(zero_copy_only=False))
                columns = [texts if i == text_at else own.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_removed)], [*names, "n_removed"])

    schema = T.StructType([*plain.schema.fields, T.StructField("n_removed", T.LongType())])
    return plain.mapInArrow(trimmed(run), schema).toDF(*docs.columns, "n_removed")


def _without_many(docs: DataFrame, lines: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same for more lines than go to every task: removals are listed by id, and the texts meet them in a shuffle."""
    places = lines.where("_id IS NOT NULL").join(first, "h").where(F.struct("_id", "place") != F.col("first"))
    gone = places.groupBy("_id").agg(F.collect_set(F.struct("place", "h")).alias("_gone")).withColumnRenamed("_id", "_gone_id")
    gone = materialise(gone, "line-removals")
    listed = F.transform("_hashes", lambda h, i: F.coalesce(F.array_contains("_gone", F.struct(i.alias("place"), h.alias("h"))) & h.isNotNull(), F.lit(False)))
    joined = _hashed(docs, text_col, keep_text=True).join(gone, F.col(id_col) == F.col("_gone_id"), "left").withColumn("_listed", listed)
    kept = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.get("_listed", i))
    some = F.col("_gone").isNotNull() & F.col(text_col).isNotNull()
    n_removed = F.when(some, F.size(F.filter("_listed", lambda x: x))).otherwise(0).cast("long").alias("n_removed")
    others = {c: F.col(c) for c in docs.columns} | {text_col: F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(text_col)}
    return joined.select(*others.values(), n_removed)


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    components: Callable[[DataFrame], DataFrame] | None = None,
    most: int = BROADCAST_ROWS,
) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines taken out of the text, and ``n_removed`` (long), how many.

    A line found at ``min_sites`` distinct sites or more stays only where it comes first: in the document with
    the smallest id, at its first place there, so that no content is lost. Blank lines are no lines and stay.
    A null text stays null and an empty one empty. A document that loses all its lines has the empty text. Rows
    that repeat an id are each looked at by themselves; where they have the first place of a line in common, each keeps it.
    Rows with a null id give to the counts and keep their texts. The other columns stay as they are; one called
    ``n_removed`` is replaced.

    With ``components``, which gives ``doc_id, component_id`` for texts (``doc_id, text``) with near copies in one
    component, the line must also be in ``min_sites`` texts that aren't near copies. So a group of copies, spread
    over however many sites, keeps its lines, and can still be recognised as one.

    Only hashes of lines are shuffled; the texts, once, only if the boilerplate lines themselves are more than ``most``.
    """
    docs = docs.drop("n_removed")
    source = docs.select(F.col(id_col).alias("_id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    hashed = materialise(_hashed(source, "text"), "line-hashes")
    lines = hashed.select("_id", "site", "key", F.posexplode("_hashes").alias("place", "h")).where("h IS NOT NULL")
    found = boilerplate(lines.select("h", "site"), min_sites)
    if components:
        found = _in_different_texts(found, lines, source, min_sites, components)
    # where each of them comes first: a smallest place per task, then one row a line
    first = lines.where("_id IS NOT NULL").join(sized(found), "h", "left_semi").groupBy("h").agg(F.min(F.struct("_id", "place")).alias("first"))
    first = materialise(first, "line-first")
    if first.count() <= most:
        return _without(docs, first, id_col, text_col)
    return _without_many(docs, lines, first, id_col, text_col)


def spread_sql(min_sites: int = MIN_SITES) -> str:
    """The SQL that the query must equal."""
    return rf"""
    WITH lines AS (
      SELECT doc_id, source, i - 1 AS place, parts[i] AS line,
        lower(trim(regexp_replace(parts[i], '[ \t\r\f\x0B]+', ' ', 'g'))) AS norm
      FROM (SELECT doc_id, source, p AS parts, unnest(range(1, len(p) + 1)) AS i
            FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents))
    ), wide AS (
      SELECT norm, min((doc_id, place)) AS first FROM lines WHERE norm != '' GROUP BY norm
      HAVING count(DISTINCT source) >= {min_sites}
    ), kept AS (
      SELECT doc_id, place, line, (wide.norm IS NOT NULL AND first != (lines.doc_id, lines.place)) AS gone
      FROM lines LEFT JOIN wide USING (norm)
    ), texts AS (
      SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
        count(*) FILTER (gone) AS n_removed FROM kept GROUP BY doc_id
    )
    SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, coalesce(n_removed, 0) AS n_removed
    FROM documents d LEFT JOIN texts t USING (doc_id)"""
