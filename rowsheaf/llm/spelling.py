"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each of them goes to.

The bigrams of a word are ordered, the rarest first, and its prefix is as many of them as one edit can spoil, and one more.
Out of the prefix, dynamic programming chooses two that don't overlap and are rarest together: its pivots. One edit
leaves one of the two as it is, so of two words one edit apart, the one whose prefix ends earlier in the order has a
pivot in the other's prefix. There it can stand at few places: with the edit behind it, where it is, and with the edit
before it, farther by as much as the word is longer. What is on its other side is equal in both words, and so is a half of
the side with the edit. Words that meet so are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.checksums import CRC_STEPS_SQL, crc32_sql
from rowsheaf.llm.text import ascii_lower
from rowsheaf.plans.files import materialise

GRAM = 2
EDITS = 1
MIN_LENGTH = 5
MIN_COUNT = 3
# A word goes to a near one that comes this many times as often, or more.
TIMES = 2
DROP_EVERY = 97

# Runs of lower-case ASCII letters and of the code points U+00C0 to U+00FF: 90 characters, so 8,100 bigrams at most.
RUN = "[a-zÀ-ÿ]+"


def corpus_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None,
) -> DataFrame:
    """``word, n`` (long) of the words of whole texts that have ``min_length`` code points and come ``min_count`` times.

    Words are runs of :data:`RUN`, A-Z in lower case. With ``drop_every``, where it divides the CRC-32 of ``<id>:<run>``,
    the run first loses the code point at that number modulo its length. A null id counts as the empty text, a null
    text has no words. Words are counted where they are, before a shuffle.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(RUN), F.lit(0))
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("own")
    found = docs.select(own, F.explode(runs).alias("run")).where(F.length("run") >= min_length)
    word = F.col("run")
    if drop_every:
        found = found.select("run", F.crc32(F.concat("own", F.lit(":"), "run")).alias("h"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        without = F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_every == 0, without).otherwise(word)
    counted = found.select(word.alias("word")).where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def pivots(places: list[tuple[int, int]], n: int = EDITS + 1, gram: int = GRAM) -> list[int]:
    """The ``n`` places, no two of them nearer than ``gram``, with the least sum of costs, out of (place, cost) by place."""
    # best[k]: cost and places of the cheapest choice of k grams among those so far that end before the next one
    ended: list[tuple[int, list]] = []
    best: list = [(0, ())] + [None] * n
    for place, cost in places:
        while ended and ended[0][0] + gram <= place:
            _, options = ended.pop(0)
            for k, option in options:
                if best[k] is None or option < best[k]:
                    best[k] = option
        ended.append((place, [(k + 1, (b[0] + cost, (*b[1], place))) for k, b in enumerate(best[:n]) if b is not None]))
    found = [o for _, options in ended for k, o in options if k == n]
    if best[n] is not None:
        found.append(best[n])
    return list(min(found)[1])


def _grams(words: DataFrame) -> DataFrame:
    """``word, prefix, pivots, last``: places of a word's prefix and pivots, and the last of the prefix in the order."""
    place = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(place, lambda i: F.col("word").substr(i, F.lit(GRAM)))).alias("gram"))
    counts = grams.groupBy("gram").count().collect()  # as many as there are pairs of letters
    order = {r["gram"]: (i, r["count"]) for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["gram"])))}
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]):
        order = shared.value
        for batch in batches:
            prefixes, chosen, lasts = [], [], []
            for word in batch.column(0).to_pylist():
                own = [order[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
                last = sorted(rank for rank, _ in own)[GRAM * EDITS]
                # all places of the last gram count, so which word's prefix has a gram depends on its order alone
                prefix = [i for i, (rank, _) in enumerate(own) if rank <= last]
                prefixes.append(prefix)
                chosen.append(pivots([(i, own[i][1]) for i in prefix]))
                lasts.append(last)
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prefixes, places), pa.array(chosen, places), pa.array(lasts, pa.int32())],
                ["word", "prefix", "pivots", "last"],
            )

    return words.select("word").mapInArrow(run, "word string, prefix array<int>, pivots array<int>, last int")


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both tables and broadcasts neither, whatever the session's threshold.

    All tables here grow with the words. Spark takes their sizes from compressed files, and an explode's from what goes
    into it, so a table of some MB may be one of hundreds in the driver.
    """
    return left.join(right.hint("merge"), on, how)


def near_words(words: DataFrame) -> DataFrame:
    """All pairs ``word, other`` of the distinct ``word``s that differ by one inserted, deleted or replaced code point.

    Both ways round. A word needs four code points, and all must be of :data:`RUN`.
    """
    grams = materialise(_grams(words), "variant-grams")
    word, p = F.col("word"), F.col("p")
    size, left, right = F.length(word), word.substr(F.lit(1), p), word.substr(p + (GRAM + 1), F.length(word))

    def keys(by: int, side: int) -> list[Column]:
        """What a word says at a gram and a word longer ``by`` so many says at its own, if the edit is on the other side."""
        place = p if side == 0 else p + by  # in the other word, as all below
        rest = size + by - place - GRAM if side == 0 else place
        head = F.call_function("div", rest, F.lit(2)).cast("int")
        tail = (rest - head).cast("int")
        # of the side with the edit, one half is equal: the edit is behind the first or before the second
        first = word.substr(p + (GRAM + 1), head) if side == 0 else word.substr(F.lit(1), head)
        second = word.substr((size if side == 0 else p) - tail + 1, tail)
        at = [word.substr(p + 1, F.lit(GRAM)), size + by, place, F.lit(side), left if side == 0 else right]
        return [F.xxhash64(*at, F.lit(0), first), F.xxhash64(*at, F.lit(1), second)]

    here = grams.select("word", "last", F.explode("prefix").alias("p"))
    said = F.explode(F.array(*keys(0, 0), *keys(0, 1))).alias("key")
    here = here.select(F.col("word").alias("other"), F.col("last").alias("other_last"), said)
    asks = grams.select("word", "last", F.explode("pivots").alias("p"))
    asks = asks.select("word", "last", F.explode(F.array(*(k for by in (-1, 0, 1) for side in (0, 1) for k in keys(by, side)))).alias("key"))
    met = _join(asks, here, "key").where((F.col("last") <= F.col("other_last")) & (F.col("word") != F.col("other")))
    pairs = met.where(F.levenshtein("word", "other") == 1)
    pairs = pairs.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")).distinct()
    pairs = materialise(pairs, "variant-pairs")
    return pairs.union(pairs.select("other", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each word with a form: what following forms ends at.

    Counts double at every step, so a way has some 60 steps at most, and each round doubles what is known of it.
    """
    hops = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = _join(hops, further, "root", "left")
        after = joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = materialise(after, "variant-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        hops = after.select("word", "root")


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word``, distinct, and ``n``, how often it comes).

    ``n_near`` (long) is how many of the words are one edit away. Of these the one with the largest ``n``, the smallest
    in code-point order among equals, is the word's ``form``, if it comes ``times`` as often or more, else null; ``form_n``
    is its ``n``. ``root`` is what following forms ends at, the word itself without one. Empty tables give empty results.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    near = _join(near_words(words), words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("best"), (-F.col("best.col1")).alias("best_n"))
    known = _join(words, best, "word", "left")
    goes = F.col("best_n") >= times * F.col("n")
    known = known.select(
        "word", F.when(goes, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(goes, F.col("best_n")).alias("form_n"),
    )
    known = materialise(known, "variant-forms")
    out = _join(known, _roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The SQL that the query must equal."""
    return rf"""
    WITH RECURSIVE {CRC_STEPS_SQL}, runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{RUN}')) AS run FROM documents
    ), distinct_runs AS (
      SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run
    ), hashed AS (
      SELECT run, times, {crc32_sql("(doc_id || ':' || run)")} AS h FROM distinct_runs, crc
    ), results AS (
      SELECT times, CASE WHEN h % {DROP_EVERY} = 0
        THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
    ), words AS (
      SELECT word, sum(times)::BIGINT AS n FROM results WHERE length(word) >= {MIN_LENGTH}
      GROUP BY word HAVING sum(times) >= {MIN_COUNT}
    ), dropped AS (
      SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
    ), near AS (
      SELECT DISTINCT d.word, w.word AS other FROM dropped d JOIN words w ON d.rest = w.word
      UNION SELECT DISTINCT w.word, d.word FROM dropped d JOIN words w ON d.rest = w.word
      UNION SELECT a.word, b.word FROM dropped a JOIN dropped b ON a.i = b.i AND a.rest = b.rest WHERE a.word != b.word
    ), best AS (
      SELECT near.word, count(*) AS n_near, min((-w.n, near.other)) AS best FROM near JOIN words w ON near.other = w.word
      GROUP BY near.word
    ), known AS (
      SELECT word, CASE WHEN -best[1] >= {TIMES} * n THEN best[2] END AS form, n,
        coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {TIMES} * n THEN -best[1] END AS form_n
      FROM words LEFT JOIN best USING (word)
    ), followed AS (
      SELECT word, form AS at FROM known WHERE form IS NOT NULL
      UNION ALL SELECT f.word, k.form FROM followed f JOIN known k ON f.at = k.word WHERE k.form IS NOT NULL
    ), ends AS (
      SELECT f.word, f.at AS root FROM followed f JOIN known k ON f.at = k.word WHERE k.form IS NULL
    )
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)"""
