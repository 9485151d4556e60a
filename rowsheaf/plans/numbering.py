"""Global row numbers and byte offsets without moving all rows to one task.

Rows live in *chunks* that follow each other in the global order: file splits for text input,
range partitions for keyed tables. Each row knows its place in its chunk; one small row per chunk
carries the chunk's totals, and an exclusive prefix sum over those tells where each chunk starts.
Everything runs inside the JVM, and the rows themselves are not shuffled for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsheaf.plans.files import estimated_bytes, materialise

ROW = "_row_no"  # 1-based global row number
SIZE = "_n_bytes"  # bytes of this row, line end included
KEY = "_chunk_key"  # what a row's chunk is found by
CHUNK = "_chunk"  # number of the row's chunk; ascending in the global order
PLACE = "_place"  # 0-based place in the chunk

# Chunk numbers all have 19 digits, so they sort the same as numbers and as names:
# this base, then the file times the stride, then the split's start in units.
CHUNK_BASE = 2 * 10**18
FILE_STRIDE = 10**12
START_UNIT = 1024

# Rows of a chunk (as a power of two) whose sizes are summed together; only blocks holding a cut are looked into.
BLOCK_BITS = 11
# How much shorter and longer than its target a part may be that is cut greedily, in bytes.
EARLY = 1024
LATE = 1024 * 1024
# Beyond this many parts per chunk on average, every row's offset is worked out instead.
CUTS_PER_CHUNK = 512

# Rows about a chunk, part or file are 40 to 100 bytes. Up to this many of them (some 300 MB; 100 TB in
# splits of 128 MB and parts of 100 MB make 1.8 million) are shipped to every executor.
BROADCAST_ROWS = 4_000_000
# By Catalyst's estimate, which takes a text for 20 bytes: long texts make several times as much.
RANGE_PARTITION_BYTES = 64 << 20
# A guard against estimates far off, as of joins: 400,000 partitions of that size are 25 TB.
MAX_RANGE_PARTITIONS = 400_000

_BLOCK = "_block"
_FIRST_33_BITS = (1 << 33) - 1


def place_in_task() -> Column:
    """0-based place of a row in its task."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_FIRST_33_BITS))


def whole(a: Column, b: Column | int) -> Column:
    """Quotient of two whole numbers, rounded down for positive ones, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def broadcast_if(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Ordered:
    """Rows in a global order that is known chunk by chunk.

    ``rows`` has :data:`KEY`, :data:`PLACE`, :data:`SIZE` if measured, the columns ``same``, and the payload.
    ``starts`` has one row per chunk: ``KEY, CHUNK, n_rows, start_row, start_bytes`` and the columns ``same``, by
    which a row checks that it is in the chunk its key stood for when chunks were totalled. ``blocks``
    (if measured) has ``KEY, _block, n_rows, n_bytes``.
    """

    rows: DataFrame
    starts: DataFrame
    blocks: DataFrame | None
    same: list[str]
    n_chunks: int
    total_rows: int
    total_bytes: int | None

    @property
    def measured(self) -> bool:
        return self.blocks is not None


def order_chunks(
    rows: DataFrame, measured: bool, same: list[str], number: Callable[[DataFrame], DataFrame]
) -> Ordered:
    """Total the chunks of ``rows`` in one pass and work out where each of them starts.

    The columns ``same`` are constant in a chunk; ``number`` adds :data:`CHUNK` to one row per chunk.
    """
    constant = [F.first(c).alias(c) for c in same]
    n_rows = F.count(F.lit(1)).alias("n_rows")
    blocks = None
    if measured:
        block = F.shiftright(PLACE, BLOCK_BITS).alias(_BLOCK)
        sums = rows.groupBy(KEY, block).agg(n_rows, F.sum(SIZE).alias("n_bytes"), *constant)
        blocks = materialise(sums, "blocks")
        chunks = blocks.groupBy(KEY).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), *constant)
        chunks = number(chunks)
    else:
        counts = rows.groupBy(KEY).agg(n_rows, F.lit(0).cast("long").alias("n_bytes"), *constant)
        chunks = materialise(number(counts), "chunks")

    # First within each file, then over the files: no window sees more than one file's chunks, and the
    # driver gets one row per input file, a list it already holds.
    grouped = chunks.withColumn("_group", whole(F.col(CHUNK) - F.lit(CHUNK_BASE), FILE_STRIDE))
    totals = grouped.groupBy("_group").agg(F.sum("n_rows"), F.sum("n_bytes"), F.count("*"))
    group_starts, total_rows, total_bytes, n_chunks = [], 0, 0, 0
    for group, rows_in, bytes_in, chunks_in in sorted(totals.collect()):
        group_starts.append((group, total_rows, total_bytes))
        total_rows, total_bytes, n_chunks = total_rows + rows_in, total_bytes + bytes_in, n_chunks + chunks_in
    groups = rows.sparkSession.createDataFrame(group_starts, "_group long, _g_rows long, _g_bytes long")
    before = Window.partitionBy("_group").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    def start(size: str, group_start: str) -> Column:
        return F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col(group_start)

    starts = grouped.join(broadcast_if(groups, len(group_starts)), "_group").select(
        KEY,
        CHUNK,
        "n_rows",
        start("n_rows", "_g_rows").alias("start_row"),
        start("n_bytes", "_g_bytes").alias("start_bytes"),
        *same,
    )
    return Ordered(rows, starts, blocks, same, n_chunks, total_rows, total_bytes if measured else None)


def _find(rows: DataFrame, ordered: Ordered, chunks: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their chunk; a row not in the chunk its key stood for raises.

    Each column is checked by itself, so the check stays whichever of them is used in the end.
    """
    there = chunks.withColumnsRenamed({c: f"_{c}_then" for c in ordered.same})
    joined = rows.join(broadcast_if(there, n), KEY, "left")
    found = F.col(CHUNK).isNotNull()
    for c in ordered.same:
        found &= F.col(c) == F.col(f"_{c}_then")
    lost = F.raise_error(F.lit("the input changed between two scans"))
    checked = [F.when(F.coalesce(found, F.lit(False)), F.col(c)).otherwise(lost).alias(c) for c in columns]
    kept = [c for c in rows.columns if c not in ordered.same]
    return joined.select(*kept, *checked)


def with_row_numbers(ordered: Ordered) -> DataFrame:
    """``rows`` with :data:`CHUNK` and :data:`ROW`."""
    starts = ordered.starts.drop("n_rows", "start_bytes")
    found = _find(ordered.rows, ordered, starts, ordered.n_chunks, [CHUNK, "start_row"])
    return found.withColumn(ROW, F.col("start_row") + F.col(PLACE) + 1).drop("start_row", KEY)


def _block_offsets(ordered: Ordered) -> DataFrame:
    """``KEY, _block, n_bytes, offset``: the byte offset each block starts at."""
    before = Window.partitionBy(KEY).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.blocks.select(
        KEY, _BLOCK, "n_bytes", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("_in_chunk")
    )
    starts = broadcast_if(ordered.starts.select(KEY, "start_bytes"), ordered.n_chunks)
    offset = (F.col("start_bytes") + F.col("_in_chunk")).alias("offset")
    return inside.join(starts, KEY).select(KEY, _BLOCK, "n_bytes", offset)


def _row_offsets(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` of the given blocks, with the byte offset ``_row_offset`` each row starts at."""
    located = rows.withColumn(_BLOCK, F.shiftright(PLACE, BLOCK_BITS)).join(blocks, [KEY, _BLOCK])
    before = Window.partitionBy(KEY, _BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("offset") + F.coalesce(F.sum(SIZE).over(before), F.lit(0))
    return located.withColumn("_row_offset", offset).drop(_BLOCK, "n_bytes", "offset")


def with_grid_parts(ordered: Ordered, target: int) -> tuple[DataFrame, DataFrame]:
    """Put rows in the cells of the byte grid of width ``target`` that their first bytes are in.

    Gives ``rows`` with :data:`CHUNK` and the 1-based ``part``, and ``part, rows`` per part that has rows.
    Where a part starts is looked up in the few blocks that hold a grid line; all other rows need only
    know which of their chunk's parts has started before them.
    """

    def cell(offset: Column) -> Column:
        return (whole(offset, target) + 1).cast("int")

    blocks = _block_offsets(ordered)
    chunks = ordered.starts.drop("start_row", "start_bytes")
    if ordered.total_bytes > target * CUTS_PER_CHUNK * max(ordered.n_chunks, 1):
        found = _find(ordered.rows, ordered, chunks, ordered.n_chunks, [CHUNK])
        rows = _row_offsets(found, blocks).withColumn("part", cell(F.col("_row_offset"))).drop("_row_offset", KEY)
        return rows, rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))

    first, last = cell(F.col("offset")), cell(F.col("offset") + F.col("n_bytes") - 1)
    n_parts = -(-ordered.total_bytes // target)
    with_line = broadcast_if(blocks.where(first != last), n_parts)
    inside = _row_offsets(ordered.rows.select(KEY, PLACE, SIZE), with_line)
    inside = inside.select(KEY, PLACE, cell(F.col("_row_offset")).alias("part"))
    heads = blocks.select(KEY, F.shiftleft(_BLOCK, BLOCK_BITS).alias(PLACE), first.alias("part"))
    part_starts = heads.unionByName(inside).groupBy(KEY, "part").agg(F.min(PLACE).alias("at"))
    return _parts_from(ordered, part_starts, n_parts)


def _parts_from(ordered: Ordered, part_starts: DataFrame, n_parts: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with :data:`CHUNK` and ``part``, and ``part, rows`` per part.

    ``part_starts`` (``KEY, part, at``): the place of each part's first row in each chunk that it has rows in.
    """
    chunks = ordered.starts.drop("start_row", "start_bytes")
    cuts = part_starts.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_cuts"))
    cuts = materialise(chunks.join(cuts, KEY), "cuts")
    found = _find(ordered.rows, ordered, cuts, ordered.n_chunks + n_parts, [CHUNK, "_cuts"])
    started = F.filter("_cuts", lambda cut: cut["at"] <= F.col(PLACE))
    rows = found.withColumn("part", F.element_at(started, -1)["part"]).drop("_cuts", KEY)

    ends = F.concat(F.slice("_cuts.at", F.lit(2), F.size("_cuts")), F.array("n_rows"))
    lengths = F.transform("_cuts", lambda cut, i: F.struct(cut["part"], (F.get(ends, i) - cut["at"]).alias("rows")))
    sizes = cuts.select(F.inline(lengths)).groupBy("part").agg(F.sum("rows").alias("rows"))
    return rows, sizes


def _next_cuts(starts: np.ndarray, at: np.ndarray, target: int, early: int, late: int, total: int) -> np.ndarray:
    """Where the part that begins at each of ``at`` ends, given the ``starts`` of rows as far as a part can reach."""
    least = at + max(target - early, 0) + 1
    places = np.searchsorted(starts, least)
    found = np.append(starts, total)[places]
    return np.where((at + target >= total) | (found > at + target + late), total, found)


def _number_cells(counts: DataFrame) -> DataFrame:
    """``_cell, before`` of ``_cell, n``: the sum of ``n`` over all cells before it, within blocks of cells first."""
    blocked = counts.withColumn("_of", whole(F.col("_cell"), 4096))
    seen, starts = 0, []
    for block, n in sorted(blocked.groupBy("_of").agg(F.sum("n")).collect()):
        starts.append((block, seen))
        seen += n
    start = counts.sparkSession.createDataFrame(starts, "_of long, _seen long")
    before = Window.partitionBy("_of").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(before), F.lit(0))
    return blocked.withColumn("_inside", inside).join(F.broadcast(start), "_of").select(
        "_cell", (F.col("_seen") + F.col("_inside")).alias("before")
    )


def with_greedy_parts(ordered: Ordered, target: int, early: int = EARLY, late: int = LATE) -> tuple[DataFrame, DataFrame]:
    """Cut one part after the other: at the first line end from ``target - early`` bytes on, counted from the part's own
    first byte. If none comes up to ``target + late`` bytes, the rest of the rows is one part.

    Gives ``rows`` with :data:`CHUNK` and the 1-based ``part``, and ``part, rows`` per part.

    Each cut depends on the one before, yet none is sought one after the other. Bytes are put into cells as wide as the
    longest step, so that whatever the cuts before are, the first cut in a run of cells is in its first cell. A
    task that has a cell and the next says for each row of the cell where a cut there leads to in the next cell. For two
    runs of cells the one's answers lead into the other's, so joining them gives those of a run twice as long, for half as many
    rows: all rounds together handle as many as the first. Then the same tables are gone down again, from the cut at 0 to the
    first cut of every cell. A task holds the rows' starts of two cells, 8 bytes each.
    """
    total, width = ordered.total_bytes, target + late
    starts = _row_offsets(ordered.rows.select(KEY, PLACE, SIZE), _block_offsets(ordered).where("n_bytes > 0"))
    starts = starts.select(KEY, PLACE, F.col("_row_offset").alias("_at"))
    starts = materialise(starts.withColumn("_cell", whole(F.col("_at"), width)), "greedy-starts")
    # the cell itself, and the one before it, which looks ahead
    seen = starts.select("_at", F.explode(F.array("_cell", F.col("_cell") - 1)).alias("_cell")).where("_cell >= 0")

    def leads(rows: pd.DataFrame) -> pd.DataFrame:
        cell = int(rows["_cell"].iloc[0])
        every = np.sort(rows["_at"].to_numpy())
        own = every[every < (cell + 1) * width]
        after = _next_cuts(every, own, target, early, late, total)
        while len(inside := np.flatnonzero(after < min((cell + 1) * width, total))):
            after[inside] = after[np.searchsorted(own, after[inside])]  # twice as far each time
        return pd.DataFrame({"_cell": cell, "_at": own, "_to": after})

    first = seen.groupBy("_cell").applyInPandas(leads, "_cell long, _at long, _to long")
    levels = [materialise(first, "greedy-leads")]
    n_cells = -(-total // width)
    while 1 << len(levels) < n_cells:
        known, run = levels[-1], 1 << (len(levels) - 1)
        odd = whole(F.col("_cell"), run) % 2 == 1
        on = known.where(odd).select(F.col("_at").alias("_to"), F.col("_to").alias("_further"))
        wider = known.where(~odd).join(on, "_to", "left")
        levels.append(materialise(wider.select("_cell", "_at", F.coalesce("_further", "_to").alias("_to")), "greedy-leads"))

    spark = ordered.rows.sparkSession
    entries = spark.createDataFrame([(0, 0)] if total else [], "_cell long, _at long")
    for level in range(len(levels) - 1, -1, -1):
        halfway = entries.join(levels[level].select("_at", "_to"), "_at").where(F.col("_to") < total)
        halfway = halfway.select(whole(F.col("_to"), width).alias("_cell"), F.col("_to").alias("_at"))
        entries = materialise(entries.select("_cell", "_at").unionByName(halfway), "greedy-entries")

    def cut(key, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entry) and len(rows):
            rows = rows.sort_values("_at", ignore_index=True)
            own = rows["_at"].to_numpy()
            after, at = _next_cuts(own, own, target, early, late, total), int(entry["_at"].iloc[0])
            while True:
                place = int(np.searchsorted(own, at))
                if place == len(own) or own[place] != at:
                    break
                found.append(place)
                at = int(after[place])
        out = rows.iloc[found][[KEY, PLACE, "_at", "_cell"]].astype("int64")
        return out.assign(_nth=np.arange(len(out)))

    cuts = starts.groupBy("_cell").cogroup(entries.groupBy("_cell"))
    cuts = materialise(cuts.applyInPandas(cut, f"{KEY} long, {PLACE} long, _at long, _cell long, _nth long"), "greedy-cuts")
    n_parts = cuts.count()
    before = _number_cells(cuts.groupBy("_cell").agg(F.count("*").alias("n")))
    part = (F.col("before") + F.col("_nth") + 1).cast("int")
    cuts = materialise(cuts.join(before, "_cell").select(KEY, PLACE, "_at", "_cell", part.alias("part")), "greedy-parts")
    # a chunk begins in the part of the last cut up to there: of its own cell or, as every cell up to the last cut has
    # one, of the cell before; beyond, in the last part
    heads = ordered.starts.select(KEY, "start_bytes").withColumn("_own", whole(F.col("start_bytes"), width))
    heads = heads.withColumn("_cell", F.explode(F.array("_own", F.col("_own") - 1)))
    heads = heads.join(cuts.select("_cell", "_at", "part"), "_cell", "left")
    reached = F.max(F.when(F.col("_at") <= F.col("start_bytes"), F.col("part")))
    heads = heads.groupBy(KEY).agg(F.coalesce(reached, F.lit(n_parts).cast("int")).alias("part"))
    heads = heads.select(KEY, F.lit(0).cast("long").alias(PLACE), "part")
    part_starts = heads.unionByName(cuts.select(KEY, PLACE, "part")).groupBy(KEY, "part").agg(F.min(PLACE).alias("at"))
    return _parts_from(ordered, part_starts, n_parts)


def range_partitions(df: DataFrame) -> int:
    """Enough range partitions to keep one near :data:`RANGE_PARTITION_BYTES`."""
    wanted = math.ceil(estimated_bytes(df) / RANGE_PARTITION_BYTES)
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(wanted, floor), MAX_RANGE_PARTITIONS)


# Names that rows get while they are numbered and split.
_OWN_NAMES = {
    ROW, SIZE, KEY, CHUNK, PLACE, _BLOCK, "_tie", "_arrival", "_row_offset", "_cuts",
    "n_rows", "n_bytes", "start_row", "start_bytes", "offset",
}


def refuse_names(df: DataFrame, others: set[str] = frozenset()) -> None:
    """Raise if a column of ``df`` has a name that the numbering would overwrite."""
    taken = [c for c in df.columns if c.lower() in _OWN_NAMES | others]
    if taken:
        raise ValueError(f"rename columns before numbering rows: {', '.join(taken)}")


def order_rows(
    df: DataFrame, order_by: list[str | Column], line: Column | None = None, unique: bool = False
) -> Ordered:
    """Put the rows of ``df`` in the order of ``order_by``; ``line`` is what their bytes are measured on.

    One range shuffle. The sorted rows go to a scratch table, because range bounds are sampled and
    a second run of the shuffle could cut elsewhere. Unless the order is ``unique``, ties are broken
    by a hash of the whole row and then by arrival, so a key that holds a third of all rows still
    spreads over many range partitions, and only identical rows are interchangeable.
    """
    refuse_names(df)
    columns = df.columns
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    wide = df.withColumn(SIZE, (F.octet_length(line) + 1).cast("long")) if line is not None else df
    if not unique:
        wide = wide.withColumn("_tie", F.xxhash64(*columns)).withColumn("_arrival", F.monotonically_increasing_id())
        keys = [*keys, F.col("_tie"), F.col("_arrival")]
    ranged = wide.repartitionByRange(range_partitions(df), *keys).sortWithinPartitions(*keys).drop("_tie", "_arrival")
    placed = ranged.withColumn(KEY, F.spark_partition_id().cast("long")).withColumn(PLACE, place_in_task())
    staged = materialise(placed, "ordered")
    return order_chunks(staged, line is not None, [], lambda c: c.withColumn(CHUNK, F.lit(CHUNK_BASE) + F.col(KEY)))
