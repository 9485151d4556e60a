"""Byte-level BPE with the tiktoken library and a local rank file; decoding from raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.text import slices

# Characters after which a long text may be cut.
CHUNK_CHARS = 1 << 16

# The pattern never matches across these places: before white space that follows something else, and
# between a digit and a letter. Only the first can be found in ordinary prose; the second helps in texts
# without white space.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[0-9])(?=[A-Za-z])")


@cache
def _encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or little more.

    A stretch without a safe boundary stays whole, however long, as its tokens depend on all of it.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str, rank_file: str, pattern: str) -> list[int]:
    """The ids of one text, as the library gives for the uncut text."""
    encoding = _encoding(rank_file, pattern)
    if len(text) <= CHUNK_CHARS:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encoding.encode_ordinary(piece)]


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """Ids of every text, and what decoding them gives back; map only, nothing is shuffled.

    Returns one row per row of ``docs``: ``id_col``, ``n_tokens`` (long), ``ids_sha256`` (digest of the
    decimal ids joined by a space), ``decoded_sha256`` (digest of the decoded bytes) and, with ``ids``,
    ``token_ids`` (array of int). A null text counts as empty: no tokens, digests of nothing. Repeated rows
    each give a row. Texts of any length are encoded whole; other columns are not looked at.
    ``rank_file`` must be readable on every executor.
    """

    def run(batches):
        encoding = _encoding(rank_file, pattern)
        decimal = [str(i) for i in range(encoding.n_vocab)]
        for batch in batches:
            for part in slices(batch):
                n_tokens, id_digests, decoded_digests, token_ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    encoded = encode(text, rank_file, pattern)
                    n_tokens.append(len(encoded))
                    joined = " ".join(map(decimal.__getitem__, encoded))
                    id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded_digests.append(hashlib.sha256(encoding.decode_bytes(encoded)).hexdigest())
                    if ids:
                        token_ids.append(encoded)
                columns = [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_digests), pa.array(decoded_digests)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(token_ids, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + (", token_ids array<int>" if ids else ""))


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the raw bytes behind its ids; null ids give null.

    Bytes, not text: a run of ids may end inside a character. An id out of range raises.
    """

    @F.pandas_udf("binary")
    def to_bytes(column):
        encoding = _encoding(rank_file, pattern)
        return column.map(lambda ids: None if ids is None else encoding.decode_bytes(list(ids)))

    return encoded.withColumn("decoded", to_bytes(F.col(ids_col)))
