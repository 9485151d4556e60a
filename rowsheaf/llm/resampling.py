"""Resampling by importance: the documents that look most like a target text, drawn without replacement.

Word runs fall into a bounded number of buckets by their CRC-32. Counts of the buckets in all documents and in all of the
target give each bucket a gain, an array that every task has, and a document's weight is the sum of its runs' gains.
Gumbel noise from the document's id makes the highest scores a draw in proportion to the weights.

The least score that is drawn is bracketed by a quantile sketch. Exact counts of the rows above and inside the bracket
say whether it holds that score; if not, it is widened. Only the rows inside are sorted, to find the last one drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.checksums import CRC_STEPS_SQL, crc32_runs, crc32_sql
from rowsheaf.llm.text import WordHasher, slices, utf8_buffer
from rowsheaf.plans.files import materialise
from rowsheaf.plans.numbering import ROW, order_rows, with_row_numbers

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
# The share of the documents with enough words that is drawn: numerator, denominator.
SHARE = (10, 100)
# Gains and scores are whole thousandths of a natural logarithm.
UNIT = 1000
# Size of the quantile sketch (a rank is off by less than 0.1 %), and the share of rows taken on each side at first.
SKETCH = 4096
MARGIN = 0.002

# All ASCII characters but digits and letters part words.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _features(part: pa.RecordBatch, hasher: WordHasher, longest: int, buckets: int, text: int) -> Iterator:
    """Bucket and row of each run of words: one pair of arrays for each length. The rows ascend."""
    data, offsets = utf8_buffer(part.column(text))
    data = _LOWER[data]
    _, rows, starts, ends = hasher.words(data, offsets)
    blank = np.append(data, np.uint8(0x20))
    state = None
    for n in range(1, longest + 1):
        if n == 1:
            state = crc32_runs(data, starts, ends)
        else:
            more = len(rows) - n + 1
            if more <= 0:
                return
            # a run that would go over the end of its text is worked out and left out below
            at_blank = np.full(more, len(data))
            state = crc32_runs(blank, at_blank, at_blank + 1, state[:more])
            state = crc32_runs(data, starts[n - 1 :], ends[n - 1 :], state)
        inside = rows[: len(rows) - n + 1] == rows[n - 1 :]
        yield (state[inside] % buckets).astype(np.int64), rows[: len(rows) - n + 1][inside]


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of the one column of ``texts`` fall into each bucket, over all rows. A null text has none."""

    def run(batches):
        hasher, counts = WordHasher(SEPARATORS), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for found, _ in _features(part, hasher, longest, buckets, 0):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    # one row a bucket and task is shuffled, one a bucket comes to the driver
    counts = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a run of each bucket adds to a document's weight, from the counts in the documents and in the target."""
    s, t, m = source.astype(float), target.astype(float), len(source)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def _weighed(docs: DataFrame, table: np.ndarray, longest: int) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight`` in place of the text, its last column."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kept = docs.columns[:-1]

    def run(batches):
        hasher, table = WordHasher(SEPARATORS), shared.value
        for batch in batches:
            for part in slices(batch, len(kept)):
                sums = np.zeros((3, part.num_rows), np.int64)
                for n, (found, rows) in enumerate(_features(part, hasher, longest, len(table), len(kept))):
                    if len(rows) == 0:
                        continue
                    own, at = np.unique(rows, return_index=True)
                    counts = np.diff(np.append(at, len(rows)))
                    sums[0, own] += counts if n == 0 else 0
                    sums[1, own] += counts
                    sums[2, own] += np.add.reduceat(table[found], at)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(s) for s in sums)], [*kept, "n_words", "n_features", "weight"]
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from a document's id, in whole units. A null id counts as the empty text."""
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(h, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-UNIT * F.log(-F.log(uniform))).cast("long")


def _last_drawn(rows: DataFrame, order: list[Column], k: int, n: int, margin: float) -> tuple[Column, Column] | None:
    """The order key of the ``k``-th of ``n`` rows, highest ``score`` first: what comes up to it is drawn."""
    sketch = materialise(rows.agg(F.kll_sketch_agg_bigint("score", F.lit(SKETCH)).alias("sketch")), "resample-sketch")
    at = (n - k) / n
    below = above = margin
    while True:
        # beyond the ends of the sketch the bracket is open
        low_rank, high_rank = max(0.0, at - below), min(1.0, at + above)
        low, high = sketch.select(
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(low_rank)),
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(high_rank)),
        ).first()
        over = F.col("score") > high if high_rank < 1 else F.lit(False)
        under = F.col("score") < low if low_rank > 0 else F.lit(False)
        n_over, n_under = rows.agg(F.count_if(over), F.count_if(under)).first()
        if n_over < k <= n - n_under:
            break
        if n_over >= k:
            above = max(4 * above, 1 / n)
        else:
            below = max(4 * below, 1 / n)
    inside = rows.where(~over & ~under).select(*(c.alias(f"_k{i}") for i, c in enumerate(order)))
    keys = [f"_k{i}" for i in range(len(order))]
    numbered = with_row_numbers(order_rows(inside, keys, unique=True)).where(F.col(ROW) == k - n_over)
    last = numbered.select(*keys).first()
    fields = inside.schema.fields
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, fields)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    longest: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    keep: list[str] | None = None,
    margin: float = MARGIN,
) -> DataFrame:
    """Weigh every row of ``docs`` by how much it looks like the texts of ``target``, and draw a share of them.

    Returns ``id_col``, the columns ``keep``, and ``n_words, n_features, weight, score, rank`` (long) for each row. Of the N
    rows with ``min_words`` words or more the ``share`` (rounded down) with the highest scores is drawn, and has ranks
    from 1; the rank of all others is null. Ties go to the smaller id, null ids last, then to fewer features. Rows
    that repeat an id are rows of their own, equal ones in any order. Null and empty texts have no words, a
    weight of 0, and aren't drawn unless ``min_words`` is 0. An empty target makes rare runs weigh more; with empty ``docs``
    the result is empty. Whole texts are read. Other columns aren't looked at; one of ``keep`` that has the name of
    a result raises.

    ``margin`` is the share of rows on each side of the cutoff that is sorted at first. It changes the work only.
    """
    keep = list(keep or [])
    results = ["n_words", "n_features", "weight", "score", "rank"]
    if clash := sorted({id_col, *keep} & set(results)):
        raise ValueError(f"rename columns that have the name of a result: {', '.join(clash)}")
    names = {id_col: "_id"} | {c: f"_keep{i}" for i, c in enumerate(keep)}
    table = gains(
        bucket_counts(docs.select(F.col(text_col).cast("string")), longest, buckets),
        bucket_counts(target.select(F.col(target_col).cast("string")), longest, buckets),
    )
    source = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text_col).cast("string").alias("_text"))
    scored = _weighed(source, table, longest).withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    scored = materialise(scored.withColumn("_nth", F.monotonically_increasing_id()), "resample-scores")

    enough = scored.where(F.col("n_words") >= min_words)
    n = enough.count()
    k = n * share[0] // share[1]
    order = [-F.col("score"), F.col("_id").isNull(), F.col("_id"), F.col("n_features"), F.col("_nth")]
    key = F.struct(*(c.alias(f"_k{i}") for i, c in enumerate(order)))
    drawn = F.lit(False)
    if k:
        drawn = (F.col("n_words") >= min_words) & (key <= _last_drawn(enough, order, k, n, margin))
    ranked = with_row_numbers(order_rows(scored.where(drawn), order, unique=True))
    others = scored.where(~drawn).withColumn(ROW, F.lit(None).cast("long"))
    both = ranked.select(*others.columns).unionByName(others).withColumnRenamed(ROW, "rank")
    return both.select(*(F.col(n).alias(c) for c, n in names.items()), *results)


def resample_sql(share: tuple[int, int] = SHARE, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> str:
    """The SQL that the query must equal."""
    words = (
        r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
    WITH {CRC_STEPS_SQL}, own AS (
      SELECT doc_id, {words.format("text")} AS words FROM documents
    ), runs AS (
      SELECT doc_id, unnest(words) AS word FROM own
    ), targets AS (
      SELECT unnest({words.format("text")}) AS word FROM benchmark
    ), counts AS (
      SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
      FROM (SELECT word, 1 AS s, 0 AS t FROM runs UNION ALL SELECT word, 0, 1 FROM targets) GROUP BY word
    ), hashed AS (
      SELECT word, s, t, {crc32_sql("word")} % {buckets} AS bucket FROM counts, crc
    ), gained AS (
      SELECT bucket, floor({UNIT} * ln((sum(t)::DOUBLE + 1) * (sum(sum(s)) OVER ()::DOUBLE + {buckets})
        / ((sum(s)::DOUBLE + 1) * (sum(sum(t)) OVER ()::DOUBLE + {buckets}))))::BIGINT AS gain
      FROM hashed GROUP BY bucket
    ), weights AS (
      SELECT doc_id, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY doc_id
    ), scored AS (
      SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-{UNIT} * ln(-ln(
        (('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM own LEFT JOIN weights USING (doc_id)
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_features >= {min_words}) AS n FROM scored
    )
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_features >= {min_words} AND place <= n * {share[0]} // {share[1]} THEN place END AS rank FROM ranked"""
