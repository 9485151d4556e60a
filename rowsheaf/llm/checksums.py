"""CRC-32 of words: many at once in numpy, and as an expression of the SQL that queries are checked against."""

from __future__ import annotations

import zlib

import numpy as np

# Words of more bytes are rare, and taken one by one.
_LONG = 64


def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_TABLE = _table()


def crc32_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each run ``data[starts:ends]``, or of what has the CRC-32 ``before`` followed by that run."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    first = np.zeros(len(order), np.uint32) if before is None else before[order]
    state = ~first
    # how many runs still have a byte at each place
    short = np.minimum(lengths, _LONG)
    active = len(order) - np.searchsorted(short[::-1], np.arange(1, (short[0] if len(order) else 0) + 1))
    for place, n in enumerate(active.tolist()):
        state[:n] = _TABLE[(state[:n] ^ data[starts[:n] + place]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    found = ~state
    for i in range(int(np.searchsorted(-lengths, -_LONG))):
        found[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(first[i]))
    out[order] = found
    return out


# One row with the list ``steps``, by which a byte is taken into the checksum: a common table expression.
CRC_STEPS_SQL = """crc AS (
      SELECT list(step ORDER BY i) AS steps FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)),
          lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS step
        FROM range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    """An expression for the CRC-32 of the bytes of ``text``, in a query over the one row of :data:`CRC_STEPS_SQL`."""
    digits = f"hex(encode({text}))"
    value = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    step = "xor(a >> 8, steps[(xor(a, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {value}), lambda a, x: {step}), 4294967295)"
