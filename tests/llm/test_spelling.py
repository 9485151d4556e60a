"""Spelling variants against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from rowsheaf.llm import spelling
from rowsheaf.llm.spelling import corpus_words, near_words, pivots, variant_groups
from rowsheaf.plans.files import materialise

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abeé", k=rng.randrange(5, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "abababab"]
    rows = [(i, " ".join(rng.choices(base, k=rng.randrange(1, 60)))) for i in range(300)]
    rows += [(7, "Maison maison, MAISON×x")] * 2 + [(None, "maisom maisom maisom"), (None, None), (500, ""), (501, "maisons " * 30_000), (502, "b" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("mine") for c in ("word", "run", "own", "h", "n", "p", "last", "key", "other", "root")})
    words = corpus_words(docs, drop_every=97)
    expected = brute_words(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == expected
    got = variant_groups(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_groups(expected)


def test_long_ways_to_the_root_and_ties(spark):
    # each word is one edit from the next, which comes twice as often; two equal neighbours at the end
    chain = ["".join("y" if j < i else "x" for j in range(12)) for i in range(13)]
    words = {w: 2**i for i, w in enumerate(chain)} | {"lower": 3, "lowes": 9, "lowed": 9, "towers": 18}
    got = variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute_groups(words)
    by = {r[0]: r for r in rows}
    assert by[chain[0]][2] == chain[-1] and by["lower"][1] == "lowed"


def test_near_words_of_every_small_alphabet_word(spark):
    # all words over two letters: every gram is frequent, and repeats in most words
    words = ["".join(w) for n in (4, 5, 6) for w in itertools.product("ab", repeat=n)]
    found = near_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(3))
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 9)))
        costs = [(p, rng.randrange(1, 6)) for p in places]
        got = pivots(costs)
        cost = dict(costs)
        best = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        assert got[1] - got[0] >= 2 and cost[got[0]] + cost[got[1]] == best


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    # all of them are below the session's threshold, as compressed tables of a million words are too
    plans = []

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])
        return rows

    def written(df, label):
        run(df)
        return materialise(df, label)

    monkeypatch.setattr(spelling, "materialise", written)
    words = {"".join(w): 1 + 3 * w.count("a") ** 3 for n in (4, 5) for w in itertools.product("ab", repeat=n)}
    rows = run(variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert sorted(map(tuple, rows)) == brute_groups(words)
    final = "".join(plans)
    assert "Broadcast" not in final and "ShuffledHashJoin" not in final
    # pairs, counts of near words, forms, at least two rounds to the roots, and the last one
    assert final.count("SortMergeJoin") >= 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variant_groups(corpus_words(docs)).count() == 0
    few = spark.createDataFrame([(1, "lonely lonely lonely a b c")], "doc_id long, text string")
    assert [tuple(r) for r in variant_groups(corpus_words(few)).collect()] == [("lonely", None, "lonely", 3, 0, None)]
