"""Language identification: log frequencies of known words, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowsheaf.llm.text import frequent, sized, slices, trimmed
from rowsheaf.plans.files import materialise

UNDETERMINED = "und"
LONGEST_GRAM = 5
# Entries that go to every Python worker, the most frequent; the others are looked up in written tables.
MODEL_WORDS = 1 << 16
MODEL_GRAMS = 1 << 16
# Entries a task counts before it passes them on.
_FLUSH = 150_000
# Characters of words whose n-grams a task counts at a time.
_CHUNK_CHARACTERS = 1 << 20
# Words whose n-grams a task takes out at a time.
_WORDS = 10_000
# Added to every count.
_PRIOR = 0.5
# The share of the likelihood that a document's language has at least, if it is taken as known.
LEAST = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case. Numbers that aren't digits, such as fractions, are no letters."""
    words = _WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]
    return words


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word between marks for its start and end."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class SharedModel:
    """Log frequencies by language of the most frequent entries. ``words`` and ``grams`` map one to its row in ``table``."""

    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def totals_of(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, Counter]]:
        """For each text the number of its words, the sum over those found here, and the others with their numbers."""
        for text in texts:
            words = words_of(text)
            rows = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
            others = Counter([words[i] for i in np.flatnonzero(rows < 0).tolist()])
            yield len(words), self.table[rows[rows >= 0]].sum(axis=0), others

    def grams_in(self, word: str) -> tuple[int, list[int], list[str]]:
        """Length of a word's longest n-grams found here (0 if none is), their rows, and its n-grams of that length or
        more that aren't here, which may still be in the written table."""
        others = []
        for n in range(LONGEST_GRAM, 0, -1):
            grams = grams_of(word, n)
            known = [self.grams[g] for g in grams if g in self.grams]
            others += [g for g in grams if g not in self.grams] if known else grams
            if known:
                return n, known, others
        return 0, [], others


@dataclass
class LanguageModel:
    """Counts of every word and n-gram that was learned, as written tables (``entry``, ``n0``, ``n1``, ... by language), and
    the most frequent ones for every task. The frequency of a count is its share of ``of_words`` or of ``of_grams`` (by
    length, from 0), by language."""

    languages: list[str]
    shared: SharedModel | None = None
    words: DataFrame | None = None
    grams: DataFrame | None = None
    of_words: np.ndarray | None = None
    of_grams: np.ndarray | None = None


def _count_words(batches):
    """(lang, word, n) of a task's documents, each pair about once."""
    counts: dict[str, Counter] = {}

    def flush():
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())],
                ["lang", "entry", "n"],
            )
        counts.clear()

    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > _FLUSH:
                yield from flush()
    yield from flush()


def _grams_of_words(langs: list[str], words: list[str], n: list[int]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of some words, each pair once.

    The n-grams of one order are numbered by the number of the n-gram before their last character, and that character.
    """
    text = "".join(f"<{w}>" for w in words)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    weights = np.repeat(np.array(n, np.int64), lengths)
    names, owners = np.unique(np.array(langs, object), return_inverse=True)
    owners = np.repeat(owners, lengths)
    _, characters = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    width = int(characters.max()) + 1
    at, number = np.arange(len(text)), owners.astype(np.int64)
    for order in range(1, LONGEST_GRAM + 1):
        fits = at + order <= ends[at]
        at, number = at[fits], number[fits]
        if not len(at):
            return
        _, first, number = np.unique(number * width + characters[at + order - 1], return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, number, weights[at])
        starts = at[first]
        grams = [text[i : i + order] for i in starts.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[owners[starts]], pa.string()), pa.array(grams, pa.string()), pa.array(counts)], ["lang", "entry", "n"]
        )


def _count_grams(batches):
    """(lang, gram, n) from rows of (lang, word, n); a gram of n characters says its own order."""
    held, size = ([], [], []), 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[1])
            if size > _CHUNK_CHARACTERS:
                yield from _grams_of_words(*held)
                held, size = ([], [], []), 0
    if held[0]:
        yield from _grams_of_words(*held)


def _by_entry(counts: DataFrame, languages: list[str], label: str) -> DataFrame:
    """One row per entry with its count in each language, from rows of (lang, entry, n), which are shuffled once."""
    columns = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    summed = counts.groupBy("entry").agg(*columns)
    every = functools.reduce(Column.__add__, [F.col(f"n{i}") for i in range(len(languages))])
    return materialise(summed.withColumn("_all", every), label)


def _sizes(languages: list[str]) -> list[Column]:
    """The sum of the counts of each language, then the number of its entries."""
    each = range(len(languages))
    return [F.sum(f"n{i}").alias(f"sum{i}") for i in each] + [F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"distinct{i}") for i in each]


def _whole(sizes: Row | None, languages: list[str]) -> list[float]:
    """By what the counts of each language are divided; ``sizes`` is a row of :func:`_sizes`, or none."""
    sizes = sizes.asDict() if sizes else {}
    return [(sizes.get(f"sum{i}") or 0) + _PRIOR * ((sizes.get(f"distinct{i}") or 0) + 1) for i in range(len(languages))]


def _most_frequent(entries: DataFrame, bound: int, languages: list[str]) -> tuple[list[str], np.ndarray]:
    kept = frequent(entries, "_all", bound).drop("_all").toPandas()
    return kept["entry"].tolist(), kept[[f"n{i}" for i in range(len(languages))]].to_numpy(np.float64)


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = MODEL_WORDS, grams: int = MODEL_GRAMS
) -> LanguageModel:
    """A model from all rows with a label; those without one, or with a null text, teach nothing.

    Words and n-grams are counted over all of every text, and all counts are kept in written tables. The ``words`` and
    ``grams`` most frequent also go to every task, which changes no prediction. Tasks count before anything is
    shuffled, which is done once for the words and once for the n-grams, by themselves and not by language, so a language with
    most of the rows spreads out. The labels are few; one value per language comes to the driver.
    """
    source = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    source = source.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labels = sorted(r["lang"] for r in source.select("lang").distinct().collect())
    if not labels:
        return LanguageModel([])
    all_words = _by_entry(source.mapInArrow(trimmed(_count_words), "lang string, entry string, n long"), labels, "language-words")
    sizes = all_words.agg(*_sizes(labels)).first()
    # a label of texts without a letter is no language
    kept = [i for i in range(len(labels)) if sizes[f"sum{i}"]]
    if not kept:
        return LanguageModel([])
    if len(kept) < len(labels):
        all_words = all_words.select("entry", "_all", *[F.col(f"n{i}").alias(f"n{k}") for k, i in enumerate(kept)])
        sizes = all_words.agg(*_sizes(kept)).first()
    languages = [labels[i] for i in kept]
    pairs = [F.struct(F.lit(lang).alias("lang"), F.col("entry"), F.col(f"n{i}").alias("n")) for i, lang in enumerate(languages)]
    pairs = all_words.select(F.inline(F.array(*pairs))).where("n > 0")
    all_grams = _by_entry(pairs.mapInArrow(trimmed(_count_grams), "lang string, entry string, n long"), languages, "language-grams")
    orders = {r["order"]: r for r in all_grams.groupBy(F.length("entry").alias("order")).agg(*_sizes(languages)).collect()}

    whole_words = np.array(_whole(sizes, languages))
    whole_grams = np.array([_whole(orders.get(k), languages) for k in range(LONGEST_GRAM + 1)])
    known, known_counts = _most_frequent(all_words, words, languages)
    pieces, piece_counts = _most_frequent(all_grams, grams, languages)
    lengths = np.array([len(p) for p in pieces], np.int64)
    table = np.log(np.concatenate([(known_counts + _PRIOR) / whole_words, (piece_counts + _PRIOR) / whole_grams[lengths]]))
    shared = SharedModel({w: i for i, w in enumerate(known)}, {g: len(known) + i for i, g in enumerate(pieces)}, table)
    return LanguageModel(languages, shared, all_words, all_grams, whole_words, whole_grams)


def _of_unseen(words: DataFrame, model: LanguageModel, shared) -> DataFrame:
    """``word, s0, s1, ...``: mean log frequencies of the longest n-grams of which any was learned; without any, no row."""
    each = range(len(model.languages))

    def run(batches):
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _WORDS):
                out = ([], [], [], [])
                sums = []
                for word in batch.column(0)[start : start + _WORDS].to_pylist():
                    n, known, others = own.grams_in(word)
                    if known:
                        for column, value in zip(out, (word, n, len(known), None)):
                            column.append(value)
                        sums.append(own.table[known].sum(axis=0))
                    for gram, times in Counter(others).items():
                        for column, value in zip(out, (word, len(gram), times, gram)):
                            column.append(value)
                        sums.append(nothing)
                sums = np.array(sums).reshape(len(sums), len(each))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
                    + [pa.array(sums[:, i]) for i in each],
                    ["word", "order", "n", "gram", *[f"s{i}" for i in each]],
                )

    nothing = np.zeros(len(each))
    sums = [f"s{i}" for i in each]
    pieces = words.mapInArrow(trimmed(run), "word string, order int, n long, gram string, " + ", ".join(f"{c} double" for c in sums))
    pieces = materialise(pieces, "language-pieces")
    asked = pieces.where("gram IS NOT NULL").select("word", "order", "n", "gram")
    found = asked.join(model.grams.withColumnRenamed("entry", "gram"), "gram")
    whole = [F.element_at(F.array(*[F.lit(float(x)) for x in model.of_grams[:, i]]), F.col("order") + 1) for i in each]
    found = found.select("word", "order", "n", *[(F.col("n") * F.log((F.col(f"n{i}") + _PRIOR) / whole[i])).alias(f"s{i}") for i in each])
    found = pieces.where("gram IS NULL").drop("gram").unionByName(found)
    found = found.groupBy("word", "order").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    longest = found.groupBy("word").agg(F.max_by(F.struct("n", *sums), "order").alias("found"))
    return longest.select("word", *[(F.col(f"found.{c}") / F.col("found.n")).alias(c) for c in sums])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``lang_pred`` and ``score`` (0 to 1) of each row of ``docs``, from its whole text alone.

    The language with the highest sum over all words, the first by name of equals, and its share of the likelihoods. A
    learned word counts with its log frequencies, any other with the mean of its longest learned n-grams. A
    text that is null or has no letter is ``und`` with score 0, as is every text for a model that has
    learned nothing. Repeated rows each give a row.

    The most frequent words and n-grams are broadcast; the other words of a text, each once, meet their counts in a
    join, the one shuffle they go through, and so do the n-grams of those never learned. Rows meet their predictions by a hash of id and text.
    """
    if not model.languages:
        return docs.select(F.col(id_col), *keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    key = _row_key(id_col, text_col)
    out = docs.select(F.col(id_col), *keep, *key).join(predictions(docs, model, id_col, text_col), ["_key_a", "_key_b"])
    return out.select(id_col, *keep, "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is known (:func:`is_accepted`), with all their columns.

    Only the keys of the others meet the texts, in a broadcast if they are few enough, else in a shuffle.
    """
    if not model.languages:
        return docs.where(F.lit(False))
    rejected = predictions(docs, model, id_col, text_col).where(~is_accepted(F.col("lang_pred"), F.col("score"), least))
    rejected = sized(materialise(rejected.select("_key_a", "_key_b"), "language-rejected"))
    return docs.select("*", *_row_key(id_col, text_col)).join(rejected, ["_key_a", "_key_b"], "left_anti").select(*docs.columns)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text."""
    a, b = F.col(id_col), F.col(text_col)
    return [F.xxhash64(a, b).alias("_key_a"), F.xxhash64(F.lit(1), b, a).alias("_key_b")]


def predictions(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_key_a, _key_b, lang_pred, score``, once for rows with the same id and text; the texts are not shuffled."""
    each = range(len(model.languages))
    sums = [f"s{i}" for i in each]
    shared = docs.sparkSession.sparkContext.broadcast(model.shared)
    source = docs.select(F.col(text_col).cast("string").alias("text"), *_row_key(id_col, text_col))

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, 0):
                found = list(own.totals_of(part.column(0).to_pylist()))
                totals = np.array([f[1] for f in found]).reshape(len(found), len(each))
                others = pa.StructArray.from_arrays(
                    [
                        pa.array([w for f in found for w in f[2]], pa.string()),
                        pa.array([n for f in found for n in f[2].values()], pa.int64()),
                    ],
                    ["word", "n"],
                )
                ends = pa.array(np.cumsum([0] + [len(f[2]) for f in found]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([f[0] for f in found], pa.int64()), pa.ListArray.from_arrays(ends, others)]
                    + [pa.array(totals[:, i]) for i in each],
                    ["_key_a", "_key_b", "n_words", "rest", *sums],
                )

    schema = "_key_a long, _key_b long, n_words long, rest array<struct<word: string, n: long>>, " + ", ".join(f"{c} double" for c in sums)
    rows = materialise(source.mapInArrow(trimmed(run), schema).withColumn("_row", F.monotonically_increasing_id()), "language-rows")

    rest = rows.select("_row", F.inline("rest"))
    counts = rest.join(model.words.withColumnRenamed("entry", "word"), "word", "left")
    learned = F.col("n0").isNotNull()
    found = counts.select(
        "_row", F.when(~learned, F.col("word")).alias("word"), "n",
        *[F.when(learned, F.col("n") * F.log((F.col(f"n{i}") + _PRIOR) / float(model.of_words[i]))).alias(f"s{i}") for i in each],
    )
    # a row for the learned words of a text, and one for each other word of it
    found = found.groupBy("_row", "word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    found = materialise(found, "language-found")
    unseen = found.where("word IS NOT NULL").select("_row", "word", "n")
    scored = _of_unseen(unseen.select("word").distinct(), model, shared)
    unseen = unseen.join(scored, "word").select("_row", *[(F.col("n") * F.col(c)).alias(c) for c in sums])
    empty = [F.lit(None).cast("long").alias(c) for c in ("_key_a", "_key_b", "n_words")]
    added = found.where("word IS NULL").select("_row", *sums).unionByName(unseen).select("_row", *empty, *sums)
    totals = rows.drop("rest").unionByName(added).groupBy("_row").agg(
        *[F.max(c).alias(c) for c in ("_key_a", "_key_b", "n_words")], F.array(*[F.sum(c) for c in sums]).alias("totals")
    )
    best, some = F.array_max("totals"), F.col("n_words") > 0
    names = F.array(*[F.lit(lang) for lang in model.languages])
    likelihoods = F.aggregate("totals", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("totals")))
    predicted = totals.select(
        "_key_a", "_key_b",
        F.when(some, F.element_at(names, F.array_position("totals", best).cast("int"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(some, 1 / likelihoods).otherwise(0.0).alias("score"),
    )
    # rows with the same id and text have the same prediction
    return predicted.groupBy("_key_a", "_key_b").agg(F.first("lang_pred").alias("lang_pred"), F.first("score").alias("score"))


def is_accepted(lang: Column, score: Column, least: float = LEAST) -> Column:
    """Whether a document's language is known: not ``und``, and at least ``least`` of the likelihood."""
    return (lang != UNDETERMINED) & (score >= least)
