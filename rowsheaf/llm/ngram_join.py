"""N-gram Jaccard join by token groups: exact links between documents, and the components they form.

A document is its set of distinct word shingles. Equal sets make a class, and one document stands for each.
The work is on token groups:

1. Every set puts its tokens in one global order, tokens known to be common last, and keeps a prefix that is
   long enough for two linked sets to share a number of prefix tokens that grows with their size.
2. Similar documents are put into groups: each goes with the one it shares most tokens with, of the smallest and the
   largest id among those that have a token. In groups of more than one block, each document is compared with
   that one, and where many are linked with it these make a group of their own, known to be connected.
3. Groups are cut into blocks of bounded size.
4. The token-group matrix holds the token union of each block, (token, block), with the range of its members' sizes. A
   document's prefix bounds its overlap with each block; only blocks with enough tokens in common and a member
   of fitting size qualify, save those of its own large component.
5. A qualifying block is opened: the union of its whole sets gives a sharper bound, and only then are its
   members compared. Links are returned only as far as they connect what isn't connected yet.

So a pair of documents is left out only if the bounds exclude a link or the two are connected anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.components import connected
from rowsheaf.llm.text import WHITE_SPACE, frequent, rolling, sized, slices, trimmed, utf8_buffer, WordHasher
from rowsheaf.plans.files import materialise, with_row_ids

# Prefix tokens that two linked sets must share: so many, and one more for each so many tokens of a set.
SHARED = 3
SHARED_EACH = 10
# Common tokens that every task knows, and how often a token must come to be one.
COMMON_TOKENS = 1 << 18
COMMON_LEAST = 16
# Members of a block, and documents that ask for it at a time, about.
BLOCK = 256
ASKING = 1024
# Documents of a component that makes a group of its own.
LARGE = 64
# Tokens a task counts at a time.
_CHUNK_TOKENS = 2 << 20


def token_sets(part: pa.RecordBatch, hasher: WordHasher, k: int, text: int = 1) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row. A text of fewer than ``k`` words is one shingle, without words none."""
    data, offsets = utf8_buffer(part.column(text))
    hashes, rows, _, _ = hasher.words(data, offsets)
    shingles = rolling(hashes, k)
    bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= k:
            own = np.sort(shingles[start : end - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif end > start:
            yield rolling(hashes[start:end], end - start)
        else:
            yield np.zeros(0, np.uint64)


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = int(np.sum(tokens * np.uint64(0x9FB21C651E98DF25), dtype=np.uint64))
        b = int(np.sum((tokens ^ (tokens >> np.uint64(29))) * (tokens | np.uint64(1)), dtype=np.uint64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _common_tokens(source: DataFrame, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that come often, sorted, and how often. Which ones are found changes the work, never the links."""

    def run(batches):
        hasher = WordHasher(WHITE_SPACE)
        held, size, seen = [], 0, set()

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for batch in batches:
            for part in slices(batch):
                for own in token_sets(part, hasher, k):
                    if len(own) and (key := _key(own)) not in seen:
                        seen.add(key)
                        held.append(own)
                        size += len(own)
                if size > _CHUNK_TOKENS:
                    yield counted()
                    held, size, seen = [], 0, set()
        if held:
            yield counted()

    counts = source.mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= COMMON_LEAST), "join-common")
    found = frequent(counts, "n", bound).toPandas()
    tokens, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _needed(n, numerator: int, denominator: int):
    """The least overlap with which a set of ``n`` can be linked."""
    return -(-n * numerator // denominator)


def _least_shared(n: Column, numerator: int, denominator: int) -> Column:
    """How many prefix tokens a set of ``n`` shares with each it is linked with, the smaller of which sets the number."""
    smaller = F.ceil(n * numerator / denominator - F.lit(1e-9))
    return F.floor(smaller / SHARED_EACH) + SHARED


def _fits(n: Column, least: Column, most: Column, numerator: int, denominator: int) -> Column:
    """Whether a set of ``n`` can be linked with one of a size from ``least`` to ``most``."""
    return (n * numerator <= most * denominator) & (least * numerator <= n * denominator)


def _prefix(tokens: np.ndarray, common: np.ndarray, often: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """The first tokens in the global order: by how common, then by hash."""
    size = len(tokens) - _needed(len(tokens), numerator, denominator) + SHARED + len(tokens) // SHARED_EACH
    if len(common):
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        known = common[at] == tokens
        if known.any():
            tokens = tokens[np.lexsort((tokens, np.where(known, often[at], 0)))]
    return tokens[:size]


def _profiles(source: DataFrame, k: int, numerator: int, denominator: int, bound: int) -> DataFrame:
    """``doc_id, n, key_a, key_b, prefix`` of every document."""
    shared = source.sparkSession.sparkContext.broadcast(_common_tokens(source, k, bound))

    def run(batches):
        hasher = WordHasher(WHITE_SPACE)
        common, often = shared.value
        for batch in batches:
            for part in slices(batch):
                n, a, b, prefixes = [], [], [], []
                for own in token_sets(part, hasher, k):
                    key = _key(own)
                    n.append(len(own))
                    a.append(key[0])
                    b.append(key[1])
                    prefixes.append(_prefix(own, common, often, numerator, denominator).view(np.int64))
                ends = np.cumsum([0] + [len(p) for p in prefixes])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    ["doc_id", "n", "key_a", "key_b", "prefix"],
                )

    return source.mapInArrow(trimmed(run), "doc_id long, n long, key_a long, key_b long, prefix array<long>")


def _sets_of(source: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Whole token sets of the documents in ``ids`` (``doc_id``), from their texts."""

    def run(batches):
        hasher = WordHasher(WHITE_SPACE)
        for batch in batches:
            for part in slices(batch):
                own = list(token_sets(part, hasher, k))
                ends = np.cumsum([0] + [len(t) for t in own])
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], ["doc_id", "tokens"])

    # ids that fit a broadcast keep the texts where they are
    ids = sized(materialise(ids, "join-wanted"))
    return source.join(ids, "doc_id", "left_semi").mapInArrow(trimmed(run), "doc_id long, tokens array<long>")


def _linked(a: pd.Series, b: pd.Series, numerator: int, denominator: int) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(denominator * both >= numerator * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _open(members: pd.DataFrame, queries: pd.DataFrame, numerator: int, denominator: int) -> pd.DataFrame:
    """Links between the components of the queries and of the members of a block, as far as they connect anything new."""
    out, parent = [], {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x] = parent.get(parent[x], parent[x])
        return x

    if len(members) and len(queries):
        sizes = np.array([len(t) for t in members["tokens"]])
        labels = members["own"].to_numpy()
        tokens = np.concatenate(members["tokens"].to_list()).view(np.uint64)
        owners = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        for label, own in zip(queries["own"], queries["tokens"]):
            own = np.asarray(own).view(np.uint64)
            low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            hit = high > low
            if hit.sum() < _needed(len(own), numerator, denominator):
                continue  # the union of the block has too few of its tokens
            width = (high - low)[hit]
            at = np.repeat(low[hit] - np.cumsum(width) + width, width) + np.arange(width.sum())
            both = np.bincount(owners[at], minlength=len(sizes))
            linked = denominator * both >= numerator * (len(own) + sizes - both)
            for other in np.unique(labels[linked]):
                a, b = root(int(label)), root(int(other))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(other), int(label)))
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def similar_components(
    docs: DataFrame,
    shingle_words: int = 5,
    threshold: tuple[int, int] = (4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
    common_tokens: int = COMMON_TOKENS,
    unique_ids: bool = False,
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``threshold`` (numerator, denominator).

    Returns ``id_col, n_shingles, component_id`` (all long) for each row of ``docs``; a component's id is the
    smallest id in it. Words are ASCII lower case, between ASCII white space, of the whole text. A text of fewer
    than ``shingle_words`` words is one shingle; without words or null it has none and links with nothing. Ids
    are whole numbers. Rows are told apart by where they stand, so rows that repeat an id may be in different
    components; a row with a null id links others like any row, and a component of such rows only has a null id.
    ``unique_ids`` says that no id is null or comes twice, not even with one text, which saves the numbering. Equal texts are one class, whatever
    their number, and copies are never paired. Other columns are not looked at.
    """
    numerator, denominator = threshold
    # with less, sets of fewer than SHARED tokens could be linked without being equal
    if not 0.75 <= numerator / denominator <= 1:
        raise ValueError("the threshold must be from 3/4 to 1")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if unique_ids:
        return _components(source, shingle_words, numerator, denominator, common_tokens).toDF(id_col, "n_shingles", "component_id")
    numbered = with_row_ids(source.withColumnRenamed("doc_id", "id"), "doc_id")
    found = _components(numbered.select("doc_id", "text"), shingle_words, numerator, denominator, common_tokens)
    found = materialise(found.join(numbered.select("doc_id", "id"), "doc_id"), "join-numbered")
    named = found.groupBy("component_id").agg(F.min("id").alias("smallest"), F.count("*").alias("rows"))
    named = sized(materialise(named.where("rows > 1").select("component_id", "smallest", F.lit(True).alias("several")), "join-names"))
    out = found.join(named, "component_id", "left")
    component = F.when(F.col("several"), F.col("smallest")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n_shingles"), component.alias("component_id"))


def _components(source: DataFrame, shingle_words: int, numerator: int, denominator: int, common_tokens: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``source`` (``doc_id``, unique and not null, and ``text``)."""
    profiles = materialise(_profiles(source, shingle_words, numerator, denominator, common_tokens), "join-profiles")
    with_words = profiles.where("n > 0")
    classes = with_words.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes, "join-classes")

    reps = classes.select(F.col("rep").alias("doc_id"))
    sizes = materialise(with_words.select("doc_id", "n").join(sized(reps), "doc_id", "left_semi"), "join-sizes")
    tokens = with_words.join(sized(reps), "doc_id", "left_semi").select("doc_id", F.explode("prefix").alias("token"))
    # tokens of a single set are most of all, and link nothing; their rows go no further
    by_token = tokens.groupBy("token").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # shared tokens grow with the documents, so this join shuffles at every size
    by_token = materialise(by_token.where("first < last"), "join-by-token")
    tokens = tokens.join(by_token, "token").join(sized(sizes), "doc_id").select("token", "doc_id", "n", "first", "last")
    tokens = materialise(tokens, "join-shared")

    groups = _groups(tokens)
    links = _verified_stars(source, groups, sizes, shingle_words, numerator, denominator)
    blocks = _blocks(groups, links)
    found = _opened(source, tokens, blocks, shingle_words, numerator, denominator)
    merged = connected(links.unionByName(found), "join-components")

    keyed = profiles.select("doc_id", "n", "key_a", "key_b")
    classes = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    out = keyed.join(classes, ["key_a", "key_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _groups(tokens: DataFrame) -> DataFrame:
    """``doc_id, n, group, crowded`` of every document with a shared token: the document it goes with, itself perhaps, and
    whether so many go with that one that they make more than a block."""
    ends = tokens.select("doc_id", "n", F.explode(F.array("first", "last")).alias("pivot")).where("doc_id != pivot")
    shares = ends.groupBy("doc_id", "n", "pivot").count()
    best = shares.groupBy("doc_id", "n").agg(F.max(F.struct("count", (-F.col("pivot")).alias("of"))).alias("best"))
    groups = materialise(best.select("doc_id", "n", F.least("doc_id", -F.col("best.of")).alias("group")), "join-groups")
    crowded = groups.groupBy("group").count().where(F.col("count") > BLOCK).select("group", F.lit(True).alias("crowded"))
    groups = groups.join(sized(materialise(crowded, "join-crowded")), "group", "left")
    return groups.select("doc_id", "n", "group", F.coalesce("crowded", F.lit(False)).alias("crowded"))


def _verified_stars(source: DataFrame, groups: DataFrame, sizes: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """Links (src, dst) between the documents of crowded groups and those they go with."""
    pairs = groups.where("crowded AND doc_id != group").select("doc_id", "n", F.col("group").alias("pivot"))
    others = sized(sizes).select(F.col("doc_id").alias("pivot"), F.col("n").alias("m"))
    fits = _fits(F.col("n"), F.col("m"), F.col("m"), numerator, denominator)
    pairs = materialise(pairs.join(others, "pivot").where(fits).select("doc_id", "pivot"), "join-stars")
    ids = pairs.select("doc_id").union(pairs.select("pivot")).distinct()
    sets = materialise(_sets_of(source, ids, k), "join-star-sets")
    paired = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("pivot"), F.col("tokens").alias("other")), "pivot")
    test = F.pandas_udf(lambda a, b: _linked(a, b, numerator, denominator), "boolean")
    links = paired.where(test("tokens", "other")).select(F.col("pivot").alias("src"), F.col("doc_id").alias("dst"))
    return materialise(links, "join-star-links")


def _blocks(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, own, block`` of every document with a shared token: a document it is known to be connected with
    (itself, if with none), and its block."""
    large = links.groupBy("src").count().where(F.col("count") >= LARGE).select("src", F.lit(True).alias("large"))
    linked = links.join(sized(materialise(large, "join-large")), "src", "left").withColumnRenamed("dst", "doc_id")
    docs = groups.join(sized(materialise(linked, "join-linked")), "doc_id", "left")
    group = F.when(F.col("large"), F.col("src")).otherwise(F.col("group"))
    docs = docs.select("doc_id", F.coalesce("src", "doc_id").alias("own"), group.alias("group"), F.coalesce("large", F.lit(False)).alias("large"))
    docs = materialise(docs, "join-docs")
    cut = docs.groupBy("large", "group").agg(F.ceil(F.count("*") / BLOCK).alias("cut"))
    docs = docs.join(cut, ["large", "group"])
    block = F.xxhash64("large", "group", F.pmod(F.xxhash64("doc_id"), "cut"))
    return materialise(docs.select("doc_id", "own", block.alias("block")), "join-blocks")


def _opened(source: DataFrame, tokens: DataFrame, blocks: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """Links (src, dst) between components, found by opening the blocks that qualify for a document."""
    placed = materialise(tokens.select("token", "doc_id", "n").join(sized(blocks), "doc_id"), "join-placed")
    matrix = placed.groupBy("token", F.col("block").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("own").alias("a"), F.max("own").alias("b")
    )
    fits = _fits(F.col("n"), F.col("least"), F.col("most"), numerator, denominator)
    # of two blocks the one with the larger number asks. Where all that have the token are connected, nothing is to be
    # found; so a large component never asks for its own blocks, nor a document for itself
    asked = placed.join(matrix, "token").where((F.col("block") >= F.col("other")) & fits)
    asked = asked.where((F.col("a") != F.col("b")) | (F.col("a") != F.col("own")))
    asked = asked.groupBy("doc_id", "n", "own", "other").count()
    asked = asked.where(F.col("count") >= _least_shared(F.col("n"), numerator, denominator))
    asked = materialise(asked.select("doc_id", "own", F.col("other").alias("block")), "join-asked")

    times = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKING).alias("times"))
    times = sized(materialise(times, "join-times"))
    members = blocks.join(times, "block").select("doc_id", "own", "block", F.explode(F.sequence(F.lit(1), "times")).alias("time"))
    asking = asked.join(times, "block").select("doc_id", "own", "block", (F.pmod(F.xxhash64("doc_id"), "times") + 1).alias("time"))
    places = members.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
    places = materialise(places, "join-places")
    sets = _sets_of(source, places.select("doc_id").distinct(), k)
    opened = sets.join(sized(places), "doc_id").groupBy("block", "time")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _open(rows[~rows["asks"]], rows[rows["asks"]], numerator, denominator)

    found = opened.applyInPandas(run, "src long, dst long")
    return materialise(found.distinct(), "join-block-links")
