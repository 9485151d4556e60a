"""Shared by the operators: text taken from Arrow batches in bounded slices, word hashes, bounded vocabularies."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that a task turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_U64 = np.uint64


def ascii_lower(column: Column) -> Column:
    """``column`` with A-Z in lower case and nothing else changed."""
    return F.translate(column, _UPPER, _UPPER.lower())


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The fold of a document by CRC-32 of its id as text; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus) == remainder


def trimmed(run: Callable) -> Callable:
    """``run`` over a task's batches, after which what it held goes back to the system.

    A Python worker goes on to other tasks, and would keep the memory of its largest one.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts make up :data:`SLICE_BYTES` or a single row; null texts become empty."""
    column = pc.fill_null(batch.column(text), "")
    batch = batch.set_column(text, batch.schema.field(text).with_nullable(True), column)
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each row starts in them (one more for the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; one to one."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(33)
    return h


class WordHasher:
    """Karp-Rabin hashes of all words in a buffer of texts, by one prefix sum modulo 2**64.

    ``separators`` are the bytes between words. A-Z count as a-z.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, separators: bytes):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        lowered = np.arange(256)
        lowered[65:91] += 32
        with np.errstate(over="ignore"):
            self.value = mix((lowered + 1).astype(np.uint64) * _U64(self._BASE)) | _U64(1)
        self._powers = self._series(self._BASE, 1)
        self._inverses = self._series(pow(self._BASE, -1, 1 << 64), 1)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, first byte and end of each word, in order."""
        n = len(data)
        if len(self._powers) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            self._powers = self._series(self._BASE, size)
            self._inverses = self._series(pow(self._BASE, -1, 1 << 64), size)
        inside = self.is_word[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        edge = offsets[:-1]
        before[edge] = False  # a text starts anew
        starts = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[edge] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * self._powers[:n], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self._inverses[starts]
            hashes = mix(hashes + (ends - starts).astype(np.uint64))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        return hashes, rows, starts, ends


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` word hashes, by position of its first."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
        return mix(out)


# The six ASCII white-space bytes.
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def frequent(counts: DataFrame, column: str, bound: int) -> DataFrame:
    """The rows with the highest ``column`` (whole, positive), ``bound`` of them at most; equal counts stay together.

    One small aggregate finds the least count, so no task sorts or gathers the whole table. Counts are
    compared in steps of a sixteenth of an octave, so a few rows fewer than the bound may come.
    """
    step = F.floor(F.log2(F.col(column)) * 16)
    histogram = counts.where(F.col(column) > 0).groupBy(step.alias("step")).count().collect()
    taken, least = 0, None
    for row in sorted(histogram, key=lambda r: -r["step"]):
        if taken + row["count"] > bound:
            break
        taken, least = taken + row["count"], row["step"]
    return counts.where(F.lit(False)) if least is None else counts.where((F.col(column) > 0) & (step >= least))


# Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1 << 20


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for a broadcast join if it has ``rows`` rows at most.

    With more rows it is returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df
