"""Likelihood of documents under a subword unigram model, summed over all segmentations.

The vocabulary is an existing tokenizer's, and every training word is an entry of its own besides. A word's
count goes to its own entry but for an absolute discount, which goes to the tokenizer's entries: as its own
segmentation of the word uses them, sharpened by expectation-maximisation over the lattices. A document is the
sequence of its words, each with a space before it, and an end mark; its probability is the sum over all ways
to cut it into entries, by forward recursion in logarithms. An entry holds no space but its first, so the
recursion passes every word start: a document's log probability is the sum of its words', and each distinct
word's lattice is built once for the whole corpus, together with those of other words of its length.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.text import frequent, held_out, slices, trimmed
from rowsheaf.plans.files import materialise

# Words whose counts are sent to every task; the others are joined.
SHARED_WORDS = 1 << 18
# Words a task counts before it passes them on.
_FLUSH = 400_000
_LN10 = math.log(10)
# Added to the count of each entry of the tokenizer, so that all of them, and so every byte, have a probability.
_PRIOR = 0.05
_END_KEY = ""  # no word is empty
# Bytes with the space before it, up to which a word's lattice is computed together with others of its length.
_LONG = 64
# Bytes of words of one length whose lattices are computed together.
_TOGETHER = 1 << 16


@cache
def _vocabulary(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


@cache
def _tokenizer(rank_file: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_vocabulary(rank_file), special_tokens={})


class Lattice:
    """All segmentations of a string into entries with log probabilities ``scores`` (by bytes).

    The entries that end at a place are found by going back from it, so edges needn't be kept: a probability needs a
    window as long as the longest entry, expected uses two numbers a byte and the edges of ``_KEPT`` bytes at most.
    """

    _KEPT = 4096

    _SCORE = -1  # the key of a node's own score; the others are bytes

    def __init__(self, scores: dict[bytes, float]):
        self.root: dict = {}  # entries from their last byte on
        self.reach = max(map(len, scores), default=0)
        for entry, score in scores.items():
            node = self.root
            for byte in reversed(entry):
                node = node.setdefault(byte, {})
            node[self._SCORE] = score

    def _into(self, word: bytes, j: int) -> list[tuple[int, float]]:
        """The (start, log probability) of the entries that end at ``j``."""
        node, own, i, reach = self.root, self._SCORE, j, self.reach
        edges = []
        for byte in reversed(word[j - reach if j > reach else 0 : j]):
            node = node.get(byte)
            if node is None:
                break
            i -= 1
            if own in node:
                edges.append((i, node[own]))
        return edges

    def _forward(self, word: bytes, size: int, found: list | None = None) -> array:
        """Log of the summed probability of all ways to reach each place, of which the last ``size`` are kept: by place, modulo.
        ``found`` gets the edges into each place."""
        exp, log, never, into = math.exp, math.log, -math.inf, self._into
        alpha = array("d", [0.0]) * size
        for j in range(1, len(word) + 1):
            edges = into(word, j)
            if found is not None:
                found.append(edges)
            if len(edges) == 1:
                i, s = edges[0]
                alpha[j % size] = alpha[i % size] + s
            elif edges:
                terms = [alpha[i % size] + s for i, s in edges]
                high = max(terms)
                alpha[j % size] = high + log(sum([exp(t - high) for t in terms])) if high > never else high
            else:
                alpha[j % size] = never
        return alpha

    def log_probability(self, word: bytes, own: float = 0.0) -> float:
        """Over all segmentations; ``own`` is the probability of the whole as one more entry."""
        size = min(self.reach, len(word)) + 1
        found = self._forward(word, size)[len(word) % size]
        if own <= 0:
            return found
        low, high = sorted((found, math.log(own)))
        return high + math.log1p(math.exp(low - high))

    def expected(self, word: bytes):
        """How often each entry is expected in a segmentation of ``word``, as (entry, share); an entry may come again.

        Backwards from the end, an edge's share is its end's share times its part of what reaches that end.
        """
        exp = math.exp
        kept = [] if len(word) <= self._KEPT else None
        alpha = self._forward(word, len(word) + 1, kept)
        if alpha[-1] == -math.inf:
            return
        share = array("d", [0.0]) * (len(word) + 1)
        share[-1] = 1.0
        for j in range(len(word), 0, -1):
            at = share[j]
            if at:
                edges = kept[j - 1] if kept else self._into(word, j)  # in a longer word they are found again
                if len(edges) == 1:
                    i = edges[0][0]
                    share[i] += at
                    yield word[i:j], at
                else:
                    total = alpha[j]
                    for i, s in edges:
                        part = at * exp(alpha[i] + s - total)
                        share[i] += part
                        yield word[i:j], part


class Trie:
    """Entries of :data:`_LONG` bytes at most, from their first byte on.

    Nodes are numbers, by depth: 0 is none and 1 the root. ``edges`` are 256 times a node plus a byte that goes on from it, in
    order, and lead to the nodes from 2 on; those of the root and of the ``near`` nodes below it are in a ``table``, too.
    ``entry`` is the number of the entry that a node ends, or -1.
    """

    def __init__(self, entries: dict[bytes, int]):
        entries = {e: i for e, i in entries.items() if 0 < len(e) <= _LONG}
        strings = sorted({e[:k] for e in entries for k in range(len(e) + 1)} | {b""}, key=lambda s: (len(s), s))
        number = {s: i for i, s in enumerate(strings, 1)}
        # by depth and bytes, strings come in the order of their edges; the last edge is none, so that there is always one to look at
        self.edges = np.array([*(number[s[:-1]] * 256 + s[-1] for s in strings[1:]), 1 << 62], np.int64)
        self.near = sum(len(s) < 2 for s in strings)
        self.table = np.zeros((self.near + 1) * 256, np.int32)
        short = np.flatnonzero(self.edges < len(self.table))
        self.table[self.edges[short]] = short + 2
        self.entry = np.array([-1, *(entries.get(s, -1) for s in strings)], np.int64)

    def follow(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The nodes that the bytes ``data`` lead to from ``nodes``, 0 where there is none."""
        asked = nodes.astype(np.int64) * 256 + data
        if nodes.max(initial=0) <= self.near:
            return self.table[asked]
        out = np.zeros(nodes.shape, np.int32)
        live = np.nonzero(nodes)
        asked = asked[live]
        at = np.searchsorted(self.edges, asked)
        out[live] = np.where(self.edges[at] == asked, at + 2, 0)
        return out


@cache
def _trie(rank_file: str) -> Trie:
    return Trie(_vocabulary(rank_file))


class Lattices:
    """What :class:`Lattice` gives for a word, for many at a time: those of one length are the columns of arrays whose rows
    are places, so each step of the recursion is taken for all of them. ``scores`` are log probabilities by the numbers
    in ``entries``. Words aren't empty; those of more than :data:`_LONG` bytes go through a :class:`Lattice` one by one."""

    def __init__(self, entries: dict[bytes, int], trie: Trie, scores: np.ndarray):
        self.entries, self.trie, self.scores = entries, trie, scores
        self.by_node = np.where(trie.entry >= 0, scores[trie.entry], -math.inf)

    @cached_property
    def _single(self) -> Lattice:
        return Lattice({e: float(self.scores[i]) for e, i in self.entries.items()})

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which words have one length, and their bytes, by place and word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths[lengths <= _LONG]).tolist():
            of_size = np.flatnonzero(lengths == size)
            for at in np.array_split(of_size, -(-len(of_size) * size // _TOGETHER)):
                data = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8)
                yield at, np.ascontiguousarray(data.reshape(len(at), size).T)

    def _edges(self, data: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By length, from 1: the nodes of the strings from each place on, 0 where no entry begins so, and the scores."""
        nodes, found = np.ones(data.shape, np.int32), []
        for length in range(1, len(data) + 1):
            nodes = self.trie.follow(nodes[: len(data) - length + 1], data[length - 1 :])
            if not nodes.any():
                break
            found.append(nodes)
        return found, [self.by_node[n] for n in found]

    @staticmethod
    def _forward(steps: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Log of the summed probability of all ways to reach each place."""
        alpha = np.zeros((shape[0] + 1, shape[1]))
        for j in range(1, len(alpha)):
            terms = np.array([alpha[j - d] + s[j - d] for d, s in enumerate(steps[:j], 1)] or [np.full(shape[1], -math.inf)])
            high = terms.max(axis=0)
            high[high == -math.inf] = 0
            with np.errstate(divide="ignore"):
                alpha[j] = high + np.log(np.exp(terms - high).sum(axis=0))
        return alpha

    def log_probabilities(self, words: list[bytes], own: np.ndarray) -> np.ndarray:
        """Of each word over all its segmentations; ``own`` are the probabilities of the wholes as one more entry each."""
        out = np.zeros(len(words))
        for at, data in self._groups(words):
            out[at] = self._forward(self._edges(data)[1], data.shape)[-1]
        for i, word in enumerate(words):
            if len(word) > _LONG:
                out[i] = self._single.log_probability(word)
        with np.errstate(divide="ignore"):
            return np.logaddexp(out, np.log(np.maximum(own, 0)))

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each entry is expected in a segmentation of each word, summed over the words: by number."""
        totals = np.zeros(len(self.scores))
        by_node = np.zeros(len(self.by_node))
        for at, data in self._groups(words):
            nodes, steps = self._edges(data)
            alpha = self._forward(steps, data.shape)
            ends = np.where(alpha > -math.inf, alpha, 0)
            parts = [np.exp(alpha[:-d] + s - ends[d:]) for d, s in enumerate(steps, 1)]
            share = np.zeros_like(alpha)
            share[-1] = alpha[-1] > -math.inf
            for j in range(len(data), 0, -1):
                for d, part in enumerate(parts[:j], 1):
                    part[j - d] *= share[j]
                    share[j - d] += part[j - d]
            for node, part in zip(nodes, parts):
                used = part > 0
                np.add.at(by_node, node[used], part[used])
        ends = self.trie.entry >= 0
        totals[self.trie.entry[ends]] = by_node[ends]
        for word in words:
            if len(word) > _LONG:
                for entry, share in self._single.expected(word):
                    totals[self.entries[entry]] += share
        return totals


def _word_counts(batches):
    """(word, in training, in all) of a task's documents; the empty word stands for the end mark."""
    counts = {True: Counter(), False: Counter()}

    def flush():
        trained, other = counts[True], counts[False]
        words = list(trained.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()).cast(pa.string()),
                pa.array([trained[w] for w in words], pa.int64()),
                pa.array([trained[w] + other[w] for w in words], pa.int64()),
            ],
            ["word", "trained", "total"],
        )
        trained.clear()
        other.clear()

    for batch in batches:
        for part in slices(batch):
            for out, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = counts[not out]
                own.update(text.encode().lower().split())
                own[b""] += 1
            if len(counts[True]) + len(counts[False]) > _FLUSH:
                yield from flush()
    yield from flush()


def _own_counts(words: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """How often the tokenizer's own segmentation of the distinct training words uses each entry: (id, n)."""

    def run(batches):
        encoding = _tokenizer(rank_file, pattern)
        totals = np.zeros(encoding.n_vocab)
        for batch in batches:
            # words hold no ASCII space, so the pattern cuts the joined text before each of them
            ids = encoding.encode_ordinary(" " + " ".join(batch.column(0).to_pylist()))
            totals += np.bincount(np.array(ids, np.int64), minlength=len(totals))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], ["id", "n"])

    return words.mapInArrow(trimmed(run), "id long, n double").groupBy("id").agg(F.sum("n").alias("n"))


def _expected_counts(words: DataFrame, rank_file: str, shared) -> DataFrame:
    """Expected uses of each entry over the lattices of the distinct training words: (id, n)."""

    def run(batches):
        lattices = Lattices(_vocabulary(rank_file), _trie(rank_file), shared.value)
        totals = np.zeros(len(shared.value))
        for batch in batches:
            totals += lattices.expected([b" " + w.encode() for w in batch.column(0).to_pylist()])
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], ["id", "n"])

    return words.mapInArrow(trimmed(run), "id long, n double").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Totals:
    """Of the training tokens: all of them, the distinct ones, the end marks, and the discount of a word."""

    tokens: int
    distinct: int
    ends: int
    discount: float


def _scores(counts: DataFrame, rank_file: str, totals: Totals) -> tuple[np.ndarray, float]:
    """Log probabilities of the tokenizer's entries by their numbers, and the sum of all counts, by which those of words are divided."""
    found = {r["id"]: r["n"] * totals.discount for r in counts.collect()}  # one row per entry of the vocabulary at most
    vocabulary = _vocabulary(rank_file)
    kept = totals.tokens - totals.discount * max(0, totals.distinct - (totals.ends > 0))
    whole = kept + sum(found.values()) + _PRIOR * (len(vocabulary) + 1)
    out = np.full(max(vocabulary.values(), default=0) + 1, -math.inf)
    for i in vocabulary.values():
        out[i] = math.log((found.get(i, 0) + _PRIOR) / whole)
    return out, whole


def score_documents(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    fold: tuple[int, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    shared_words: int = SHARED_WORDS,
    em_rounds: int = 1,
) -> DataFrame:
    """Score every whole text, learning from the documents outside the held-out ``fold`` (modulus, remainder).

    Returns one row per row of ``docs``: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens`` (long),
    ``base_score`` (whole words with one added to each count) and ``score`` (the subword model), both log10. Tokens
    are words in ASCII lower case between ASCII white space, then one end. A null text counts as empty: one token.
    A null id counts as an empty id for the fold. Repeated rows are scored each; without training documents nothing
    is known and every entry of the tokenizer is equally likely. Other columns are not looked at.

    All words of all documents are counted before the shuffle and once after it. The ``shared_words`` most frequent
    over all documents go to every task; the rest, few rows each, meet their counts in a join.
    """
    spark = docs.sparkSession
    source = docs.select(held_out(F.col(id_col), *fold).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("_id"))
    counts = source.select("held_out", "text").mapInArrow(trimmed(_word_counts), "word string, trained long, total long")
    counts = materialise(counts.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total")), "lm-words")
    sums = counts.agg(
        F.sum("trained").alias("n"), F.sum((F.col("trained") > 0).cast("long")).alias("v"),
        F.sum(F.when(F.col("word") == _END_KEY, F.col("trained"))).alias("ends"),
        *[F.sum(((F.col("trained") == k) & (F.col("word") != _END_KEY)).cast("long")).alias(f"n{k}") for k in (1, 2)],
    ).first()
    n, v, ends, once, twice = (int(x or 0) for x in sums)
    totals = Totals(n, v, ends, once / (once + 2 * twice) if once else 0.5)

    learned = counts.where((F.col("trained") > 0) & (F.col("word") != _END_KEY)).select("word")
    scores, whole = _scores(_own_counts(learned, rank_file, pattern), rank_file, totals)
    for _ in range(em_rounds):
        shared = spark.sparkContext.broadcast(scores)
        scores, whole = _scores(_expected_counts(learned, rank_file, shared), rank_file, totals)
    shared = spark.sparkContext.broadcast(scores)

    def add_lattice(batches):
        lattices = Lattices(_vocabulary(rank_file), _trie(rank_file), shared.value)
        for batch in batches:
            words, trained = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = lattices.log_probabilities([b" " + w.encode() for w in words], (trained - totals.discount) / whole) / _LN10
            for i in (i for i, w in enumerate(words) if w == _END_KEY):
                found[i] = math.log10((trained[i] + _PRIOR) / whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "lattice"])

    words = materialise(counts.mapInArrow(trimmed(add_lattice), "word string, trained long, total long, lattice double"), "lm-lattice")
    top = frequent(words, "total", shared_words).toPandas()
    top = spark.sparkContext.broadcast(
        ({w.encode(): i for i, w in enumerate(top["word"])}, top["trained"].to_numpy(np.int64), top["lattice"].to_numpy(np.float64))
    )
    floor = math.log10(n + v + 1)

    def add_shared(batches):
        places, trained, lattice = top.value
        base = np.log10(trained + 1.0) - floor
        known = trained > 0
        get = places.get
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    tokens = text.encode().lower().split()
                    tokens.append(b"")
                    at = np.array([get(t, -1) for t in tokens])
                    hit = at[at >= 0]
                    rest = Counter([tokens[i] for i in np.flatnonzero(at < 0)])
                    rows.append((len(tokens), int(known[hit].sum()), float(base[hit].sum()), float(lattice[hit].sum()), rest))
                sizes = np.cumsum([0] + [len(r[4]) for r in rows])
                rare = pa.StructArray.from_arrays(
                    [
                        pa.array([w for r in rows for w in r[4]], pa.binary()).cast(pa.string()),
                        pa.array([c for r in rows for c in r[4].values()], pa.int64()),
                    ],
                    ["word", "n"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(0),
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rare),
                    ],
                    ["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"],
                )

    kind = source.schema["_id"].dataType.simpleString()
    schema = (
        f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double,"
        " rest array<struct<word: string, n: long>>"
    )
    rows = source.mapInArrow(trimmed(add_shared), schema).withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(rows, "lm-rows")
    rest = rows.select("_row", F.inline("rest")).join(words, "word")
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("n") * (F.log10(F.col("trained") + 1.0) - floor)).alias("base_score"),
        F.sum(F.col("n") * F.col("lattice")).alias("score"),
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("_id", kind), ("held_out", "boolean"), ("n_tokens", "long"))]
    parts = rows.drop("rest").unionByName(rest.select("_row", *empty, "n_known", "base_score", "score"))
    summed = parts.groupBy("_row").agg(
        F.max("_id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")],
    )
    return summed.select(
        id_col, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
