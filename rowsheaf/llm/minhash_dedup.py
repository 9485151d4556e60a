"""Near-duplicates by circulant MinHash: two permutations give every coordinate of a signature.

The first permutation scatters a document's shingles over a circle. Coordinate k is the least value that the second one
gives to a shingle's place shifted by k. Bands of a few coordinates each put documents into buckets, and there are so many
bands that a pair with the least similarity misses all of them once in a thousand million times.

1. Equal sets make a class, which one row stands for.
2. Every class is compared, on full sets, with the smallest class of the buckets it shares, the one it shares most with.
   Large groups of copies come together here, at a cost that grows with their members only.
3. Buckets that still hold several components are compared in blocks of bounded size. Signatures are compared first, in the
   first band that two classes share; classes without a likely partner in another component go no further.
4. The rest are compared on full sets, again in blocks, and links are returned as far as they connect anything new.

No list of pairs is ever made, and no bucket is cut short.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.components import connected
from rowsheaf.llm.ngram_join import token_sets
from rowsheaf.llm.text import WHITE_SPACE, WordHasher, mix, sized, slices
from rowsheaf.plans.files import materialise

# Coordinates in a band, and how often a pair with the least similarity may miss all bands.
ROWS = 4
MISSED = 1e-9
# Standard errors by which a signature may understate the similarity of a linked pair.
SURE = 6.5
# Classes whose signatures, and shingles whose sets, a task compares with as many others at a time.
BLOCK = 4096
BLOCK_TOKENS = 1 << 20
# Shingles that are hashed at a time: their arrays stay in a processor's cache.
_CHUNK = 1 << 15

_PROFILE = "doc_id long, n long, key_a long, key_b long, bands array<long>, signature binary"


def n_bands(threshold: tuple[int, int], rows: int = ROWS) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (threshold[0] / threshold[1]) ** rows - 1e-12))


def places(tokens: np.ndarray) -> np.ndarray:
    """The first permutation: of 64-bit hashes, seen on a circle of 2^32 places."""
    with np.errstate(over="ignore"):
        return (mix(tokens ^ np.uint64(0x8A5CD789635D2DFF)) >> np.uint64(32)).astype(np.uint32)


def signatures(place: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """``coordinates`` minima for each of the runs of places that begin at ``starts``, none of them empty."""
    out = np.empty((len(starts), coordinates), np.uint32)
    ends = np.append(starts[1:], len(place))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, side="right")))
        own, at = place[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
        h, shifted = np.empty_like(own), np.empty_like(own)
        with np.errstate(over="ignore"):
            for k in range(coordinates):
                # the second permutation, of the circle shifted by k: steps that can each be undone
                np.add(own, np.uint32(k), out=h)
                for multiplier, by in ((0x9E3779B1, 15), (0x85EBCA77, 13), (0xC2B2AE3D, 16)):
                    np.multiply(h, np.uint32(multiplier), out=h)
                    np.right_shift(h, np.uint32(by), out=shifted)
                    np.bitwise_xor(h, shifted, out=h)
                out[first:last, k] = np.minimum.reduceat(h, at)
        first = last
    return out


def _band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One number for each run of ``rows`` coordinates, with the band's place in it."""
    bands = signature.astype(np.uint64).reshape(len(signature), -1, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
        for i in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i] + np.uint64(1))
    return out.view(np.int64)


def _set_keys(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    with np.errstate(over="ignore"):
        a = np.add.reduceat(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)), starts)
        b = np.add.reduceat(mix(tokens + np.uint64(0x9E3779B97F4A7C15)), starts)
    return a.view(np.int64), b.view(np.int64)


def _sets(batches, k: int):
    """For each slice: the slice, sizes, and the flat shingles of the rows that have any, with their starts."""
    hasher = WordHasher(WHITE_SPACE)
    for batch in batches:
        for part in slices(batch):
            own = list(token_sets(part, hasher, k))
            sizes = np.array([len(t) for t in own], np.int64)
            held = np.flatnonzero(sizes)
            if len(held):
                yield part, sizes, held, np.concatenate(own), np.cumsum(sizes[held]) - sizes[held]
            else:
                yield part, sizes, held, np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _profiles(source: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, key_a, key_b, bands, signature`` of every row; null but for id and size without words."""

    def run(batches):
        for part, sizes, held, tokens, starts in _sets(batches, k):
            keys, found, low = np.zeros((2, len(sizes)), np.int64), np.zeros((0, bands), np.int64), np.zeros((0, bands * rows), np.uint8)
            if len(held):
                signature = signatures(places(tokens), starts, bands * rows)
                keys[0, held], keys[1, held] = _set_keys(tokens, starts)
                found, low = _band_hashes(signature, rows), signature.astype(np.uint8)
            none = sizes == 0
            ends = np.cumsum(~none) * bands
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found.ravel()), mask=pa.array(none))
            data = [None] * len(sizes)
            for i, row in zip(held.tolist(), low):
                data[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), lists, pa.array(data, pa.binary())],
                ["doc_id", "n", "key_a", "key_b", "bands", "signature"],
            )

    return source.mapInArrow(run, _PROFILE)


def _sets_of(source: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node, tokens`` of the classes in ``wanted`` (``node, doc_id, key_a, key_b``), from the texts of their ids' rows."""

    def run(batches):
        for _, sizes, held, tokens, starts in _sets(batches, k):
            if len(held):
                a, b = _set_keys(tokens, starts)
                ends = pa.array(np.append(starts, len(tokens)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), lists], ["key_a", "key_b", "tokens"])

    # an id may be repeated or null, so what is read is checked by the set's key, and equal sets are taken once
    ids = sized(materialise(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), "copies-ids"))
    texts = source.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    read = texts.mapInArrow(run, "key_a long, key_b long, tokens array<long>")
    keyed = read.join(sized(wanted.select("node", "key_a", "key_b")), ["key_a", "key_b"])
    return materialise(keyed.groupBy("node").agg(F.first("tokens").alias("tokens")), "copies-sets")


def _blocks(members: DataFrame, key: str, weight: Column, bound: int) -> DataFrame:
    """``members`` once for every pair of blocks (``i`` up to ``j``) of their ``key`` that they are in, with their ``side``.

    A key is cut into so many blocks that each has ``bound`` in weight, about. Keys of a single block are brought together
    by ``pack``, so that a task has groups of some size to work on.
    """
    cut = members.groupBy(key).agg(F.sum(weight).alias("weight")).withColumn("cut", F.ceil(F.col("weight") / bound).cast("int"))
    cut = sized(materialise(cut, "copies-cuts"))
    placed = members.join(cut, key).withColumn("own_block", F.pmod(F.xxhash64("node"), "cut").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    i, j = F.least("own_block", "other"), F.greatest("own_block", "other")
    packs = (cut.where("cut = 1").agg(F.sum("weight")).first()[0] or 0) // bound * 4 + 1
    # the packs' numbers and the hashes of large keys may meet, which costs time only
    pack = F.when(F.col("cut") == 1, F.pmod(F.xxhash64(key), F.lit(packs))).otherwise(F.xxhash64(key))
    added = {"i": i, "j": j, "side": F.col("own_block") != i, "pack": pack}
    return placed.withColumns(added).drop("cut", "weight", "own_block", "other")


def _screened(rows: pd.DataFrame, least: int, numerator: int, denominator: int) -> pd.DataFrame:
    """Of the members of two blocks of a bucket, or of many small buckets, those with a likely partner in another component.

    A pair counts in the first band it shares only, so that it is looked at once.
    """
    rows = rows.sort_values(["bucket", "side"])
    buckets, nodes, own, n = (rows[c].to_numpy() for c in ("bucket", "node", "own", "n"))
    signature = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
    bands = np.array(rows["bands"].to_list(), np.int64)
    found = np.zeros(len(rows), bool)
    side, diagonal = rows["side"].to_numpy(), bool((rows["i"] == rows["j"]).iloc[0])
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    for start, end in zip(starts, np.append(starts[1:], len(rows))):
        # of a block with itself every pair is looked at from its first; else the one side looks at the other
        asking = end if diagonal else start + int(np.count_nonzero(~side[start:end]))
        for q in range(start, asking):
            first = q + 1 if diagonal else asking
            fits = (n[first:end] * denominator >= n[q] * numerator) & (n[q] * denominator >= n[first:end] * numerator)
            at = np.flatnonzero(fits & (own[first:end] != own[q])) + first
            if len(at):
                at = at[np.count_nonzero(signature[at] == signature[q], axis=1) >= least]
            if len(at):
                shared = bands[at] == bands[q]
                at = at[bands[q][np.argmax(shared, axis=1)] == buckets[q]]
            if len(at):
                found[q] = True
                found[at] = True
    return pd.DataFrame({"bucket": buckets[found], "node": nodes[found], "own": own[found], "n": n[found]})


def _linked(rows: pd.DataFrame, numerator: int, denominator: int) -> pd.DataFrame:
    """Links between the components (``own``) of the two sides of a block pair, as far as they connect anything new."""
    diagonal = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
    asking, members = (rows, rows) if diagonal else (rows[~rows["side"]], rows[rows["side"]])
    out, parent = [], {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    if len(asking) and len(members):
        sizes = members["tokens"].map(len).to_numpy()
        labels = members["own"].to_numpy()
        tokens = np.concatenate(members["tokens"].to_list())
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], np.repeat(np.arange(len(members)), sizes)[order]
        for label, own in zip(asking["own"].tolist(), asking["tokens"]):
            low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            width = high - low
            at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
            both = np.bincount(owners[at], minlength=len(sizes))
            similar = denominator * both >= numerator * (len(own) + sizes - both)
            for other in np.unique(labels[similar]).tolist():
                a, b = root(label), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((other, label))
    return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")


def _stars(shared: DataFrame, sets: DataFrame, sizes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links of each class with the smallest one of its buckets, the one it shares most buckets with."""
    shares = shared.where("node != first").groupBy("node", F.col("first").alias("pivot")).count()
    best = shares.groupBy("node").agg(F.max(F.struct("count", (-F.col("pivot")).alias("of"))).alias("best"))
    pairs = best.select("node", (-F.col("best.of")).alias("pivot")).join(sizes, "node")
    pairs = materialise(pairs, "copies-stars")
    parts = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"))
    parts = materialise(parts, "copies-star-parts")
    members = pairs.join(sized(parts), "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    pivots = parts.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.unionByName(pivots).join(sets, "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["node"].to_numpy()
        rows = rows.assign(own=own, i=0, j=1, side=(rows["node"] == rows["pivot"]).to_numpy())
        return _linked(rows, numerator, denominator)

    return materialise(rows.groupBy("pivot", "part").applyInPandas(run, "src long, dst long"), "copies-star-links")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    threshold: tuple[int, int] = (4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = ROWS,
    bands: int | None = None,
) -> DataFrame:
    """Components of rows linked by a Jaccard similarity of at least ``threshold`` (numerator, denominator).

    Returns ``id_col, n_shingles, component_id`` (long) and ``kept`` (boolean) for each row of ``docs``. ``component_id`` is
    the smallest id that links reach from a row, its own included, and ``kept`` says that it is the row's own. Words are ASCII
    lower case, between ASCII white space, of the whole text; a text of fewer than ``shingle_words`` words is one shingle,
    without words or null it has none and links with nothing. Every link is confirmed on full sets.

    Rows are told apart by their sets, not their ids, so rows that repeat an id link as any others do, and with equal sets
    are equal rows, all kept or none. Rows with a null id link as well; a component of such rows only has a null id, and
    keeps all its rows. Empty tables give empty results. Other columns aren't looked at.
    """
    numerator, denominator = threshold
    if not 0 < numerator <= denominator:
        raise ValueError("the threshold must be over 0 and up to 1")
    bands = bands or n_bands(threshold, rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = _profiles(source, shingle_words, bands, rows).withColumn("row", F.monotonically_increasing_id())
    profiles = materialise(profiles, "copies-profiles")
    classes = profiles.where("n > 0").groupBy("key_a", "key_b").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min(F.struct("row", "doc_id", "n")).alias("first")
    )
    classes = classes.select("key_a", "key_b", "node", "least", F.col("first.doc_id").alias("doc_id"), F.col("first.n").alias("n"))
    classes = materialise(classes, "copies-classes")
    # one row of each class, by a checked broadcast of row numbers
    heads = profiles.withColumnRenamed("row", "node").join(sized(classes.select("node")), "node", "left_semi")
    heads = heads.select("node", "n", "bands", "signature")

    banded = heads.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = materialise(banded.join(materialise(buckets, "copies-buckets"), "bucket").select("bucket", "node", "first"), "copies-shared")
    nodes = materialise(shared.select("node").distinct(), "copies-nodes")
    wanted = materialise(classes.join(nodes, "node").select("node", "doc_id", "key_a", "key_b", "n"), "copies-wanted")
    sets = _sets_of(source, wanted, shingle_words)
    stars = _stars(shared, sets, wanted.select("node", "n"), numerator, denominator)

    known = connected(stars, "copies-star-components").withColumnRenamed("component", "own")
    open_rows = shared.join(known, "node", "left").select("bucket", "node", F.coalesce("own", "node").alias("own"))
    open_rows = materialise(open_rows, "copies-owned")
    several = open_rows.groupBy("bucket").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b").select("bucket")
    open_rows = open_rows.join(materialise(several, "copies-several"), "bucket", "left_semi").join(heads, "node")
    ratio, coordinates = numerator / denominator, bands * rows
    least = math.ceil(coordinates * ratio - SURE * math.sqrt(coordinates * ratio * (1 - ratio)))
    screened = _blocks(materialise(open_rows, "copies-open"), "bucket", F.lit(1), BLOCK).groupBy("pack", "i", "j").applyInPandas(
        lambda rows: _screened(rows, least, numerator, denominator), "bucket long, node long, own long, n long"
    )
    likely = materialise(materialise(screened, "copies-screened").distinct(), "copies-likely")
    compared = _blocks(likely, "bucket", F.col("n"), BLOCK_TOKENS).join(sets, "node").groupBy("pack", "i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_linked(own, numerator, denominator) for _, own in rows.groupby("bucket")], ignore_index=True)

    found = compared.applyInPandas(compare, "src long, dst long")
    merged = connected(stars.unionByName(materialise(found, "copies-links")), "copies-components")

    placed = classes.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed.select("key_a", "key_b", "least", "component"), "copies-placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = placed.join(ids, "component").select("key_a", "key_b", "component_id")
    out = profiles.select("doc_id", "n", "key_a", "key_b").join(by_key, ["key_a", "key_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
