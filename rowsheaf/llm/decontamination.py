"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words: runs of letters, marks and digits, in lower case. Runs of
``min_match`` words that both have are the seeds. A pair whose seeds could cover enough of the item is tiled:
running Karp-Rabin matches, long lengths first, give the longest common runs that do not overlap, which are marked
one after the other. The share of the item's words under tiles decides, in whatever order they come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.text import WordHasher, rolling, slices, utf8_buffer

MIN_MATCH = 5
COVERAGE = 0.5
# Bytes of benchmark text that every task holds at a time; more is taken in several passes.
BLOCK_BYTES = 16 << 20
# Length at which the search for matches starts.
_FIRST_LENGTH = 20
_FILTER_BITS = 22


def _words(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a column without nulls."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.string())), r"[^\p{L}\p{M}\p{N}]+", " ")
    hashes, rows, _, _ = hasher.words(*utf8_buffer(plain))
    return hashes, rows


def _matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of free words, of ``size`` words or more: (length, place in doc, place in item)."""

    def open_runs(words, free):
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[size:] == taken[:-size]) if len(words) >= size else np.zeros(0, np.int64)

    places: dict[int, list[int]] = {}
    item_runs = rolling(item, size)
    for j in open_runs(item, item_free):
        places.setdefault(int(item_runs[j]), []).append(int(j))
    if not places:
        return []
    doc_runs, candidates = rolling(doc, size), open_runs(doc, doc_free)
    candidates = candidates[np.isin(doc_runs[candidates], np.fromiter(places, np.uint64, len(places)))]
    out = []
    for i in map(int, candidates):
        for j in places[int(doc_runs[i])]:
            if i and j and doc_free[i - 1] and item_free[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # part of the run that starts before it
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc_free[i + n] and item_free[j + n] and doc[i + n] == item[j + n]:
                n += 1
            if n >= size:
                out.append((n, i, j))
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles of two word sequences: (length, place in doc, place in item), longest first, ties from the left."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, size = [], max(min_match, _FIRST_LENGTH)
    while True:
        found = _matches(doc, item, doc_free, item_free, size)
        longest = max(found, default=(0,))[0]
        if longest > 2 * size:
            size = longest  # few runs are so long; they come first
            continue
        if found:
            for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
                if doc_free[i : i + n].all() and item_free[j : j + n].all():
                    doc_free[i : i + n] = item_free[j : j + n] = False
                    tiles.append((n, i, j))
            continue  # what is left of overlapped runs may still be long enough
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


class _Benchmark:
    """A block of items, with their seeds in order."""

    def __init__(self, items: pd.DataFrame, min_match: int):
        self.min_match, self.ids = min_match, items["item_id"].to_list()
        hashes, rows = _words(pc.fill_null(pa.array(items["text"], pa.string()), ""), WordHasher(b" "))
        bounds = np.searchsorted(rows, np.arange(len(items) + 1))
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        seeds = [rolling(w, min_match) for w in self.words]
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owners = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        self.places = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners, self.places = self.seeds[order], self.owners[order], self.places[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True
        # items shorter than a seed, by their length: their whole sequences in order, and whose they are
        self.short = {}
        for size in range(1, min_match):
            owners = np.array([k for k, w in enumerate(self.words) if len(w) == size], np.int64)
            if len(owners):
                whole = np.concatenate([rolling(self.words[k], size) for k in owners])
                order = np.argsort(whole, kind="stable")
                self.short[size] = whole[order], owners[order]

    def short_in(self, doc: np.ndarray):
        """(item, words, covered, tiles, longest) of each item shorter than a seed of which ``doc`` has all words in a row."""
        for size, (whole, owners) in self.short.items():
            if len(doc) >= size:
                for k in owners[np.isin(whole, rolling(doc, size))]:
                    yield self.ids[k], size, size, 1, size

    def found_in(self, doc: np.ndarray, coverage: float):
        """(item, words, covered, tiles, longest) for each item of which ``doc`` covers enough."""
        if len(doc) < self.min_match:
            return
        runs = rolling(doc, self.min_match)
        at = np.flatnonzero(self.maybe[runs >> np.uint64(64 - _FILTER_BITS)])
        # each seed once, however often the document repeats it, so that repetitions are not multiplied by those of the items
        seeds, which = np.unique(runs[at], return_inverse=True)
        low = np.searchsorted(self.seeds, seeds)
        width = np.searchsorted(self.seeds, seeds, side="right") - low
        if not width.any():
            return
        hits = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
        order = np.argsort(self.owners[hits], kind="stable")
        owners, item_at = self.owners[hits][order], self.places[hits][order]
        seed_of = np.repeat(np.arange(len(seeds)), width)[order]
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(owners)]):
            k = owners[start]
            item = self.words[k]
            if len(self._around(item_at[start:end])) < coverage * len(item):
                continue
            # a run of matching words lies in seeds, so the rest of the document can be left out
            shared = np.zeros(len(seeds), bool)
            shared[seed_of[start:end]] = True
            near = self._around(at[shared[which]])
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            cut = np.insert(doc[near], gaps, np.arange(len(gaps), dtype=np.uint64))
            tiles = tile(cut, item, self.min_match)
            covered = sum(t[0] for t in tiles)
            if covered >= coverage * len(item):
                yield self.ids[k], len(item), covered, len(tiles), max(t[0] for t in tiles)

    def _around(self, starts: np.ndarray) -> np.ndarray:
        return np.unique((np.unique(starts)[:, None] + np.arange(self.min_match)).ravel())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The benchmark items (``item_id, text``) found in each document.

    Returns ``id_col, item_id, item_words, covered_words, n_tiles, longest_tile, doc_words`` (long) and ``coverage`` (double);
    an id column with the name of another of these comes as ``doc_<name>``. There is one row for each row of ``docs`` and item of which tiles of at least ``min_match`` words cover the share
    ``coverage``. An item of fewer than ``min_match`` words is one seed by itself: it is found where all its words follow each
    other, also inside a longer text, which for one or two words may mean little; ``item_words`` and ``doc_words`` tell. Null and empty texts
    and items match nothing. Repeated documents or items each give their rows. Other columns are not looked at.

    The documents are not shuffled. The benchmark goes to every task in blocks of about ``BLOCK_BYTES``, each in a
    pass of its own over the documents.
    """
    spark = docs.sparkSession
    # names of its own inside, as the id may be called like any of the others
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    kind, item_kind = (f.schema[0].dataType.simpleString() for f in (source, items))
    names = ["_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", "doc_words", "coverage"]
    schema = (
        f"_id {kind}, item_id {item_kind}, item_words long, covered_words long, n_tiles long, longest_tile long,"
        " doc_words long, coverage double"
    )
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block).toPandas()
        shared = spark.sparkContext.broadcast(_Benchmark(own, min_match))

        def run(batches, shared=shared):
            known, hasher = shared.value, WordHasher(b" ")
            id_type = pa.int64()
            for batch in batches:
                id_type = batch.schema.field(0).type
                found = []
                for part in slices(batch):
                    hashes, rows = _words(part.column(1), hasher)
                    bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                    runs = rolling(hashes, known.min_match)
                    # rows with a seed at all; the filter also passes runs over two rows, which do no harm
                    at = np.flatnonzero(known.maybe[runs >> np.uint64(64 - _FILTER_BITS)])
                    seeded = np.unique(rows[at])
                    for r in np.unique(rows) if known.short else seeded:
                        doc = hashes[bounds[r] : bounds[r + 1]]
                        for hit in [*known.found_in(doc, coverage), *known.short_in(doc)]:
                            found.append((part.column(0)[int(r)].as_py(), *hit, len(doc), hit[2] / hit[1]))
                columns = list(zip(*found)) if found else [[] for _ in names]
                types = [id_type, None, *[pa.int64()] * 5, pa.float64()]
                arrays = [pa.array(c, t) if t else pa.array(c) for c, t in zip(columns, types)]
                if found:
                    yield pa.RecordBatch.from_arrays(arrays, names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.toDF(f"doc_{id_col}" if id_col in names else id_col, *names[1:])
