"""Circulant MinHash against brute force, with nulls, repeated rows and ids, long texts, large groups and empty tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsheaf.llm import minhash_dedup
from rowsheaf.llm.minhash_dedup import n_bands, near_duplicates, places, signatures

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, numerator, denominator):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * denominator >= max(len(a), len(b)) * numerator:
            both = len(a & b)
            if denominator * both >= numerator * (len(a) + len(b) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(2, 120))
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    passage = rng.choices(vocabulary, k=40)
    for _ in range(40):  # one passage, and as many words of their own
        rows.append((len(rows), " ".join(rng.choices(vocabulary, k=20) + passage + rng.choices(vocabulary, k=20))))
    rows += [(3, rows[3][1]), (3, "another text under the same id"), (900, "another text under the same id"), (None, rows[5][1].upper())]
    rows += [(None, None), (None, "only null ids say this"), (None, "only  null ids say this"), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE ")]
    return rows + [(905, "long " * 50_000), (906, "long long long\nlong " * 9), (907, "x" * 300_000)]


@pytest.mark.parametrize("k, threshold, block", [(4, (80, 100), 4096), (5, (4, 5), 7), (2, (1, 2), 5)])
def test_components_equal_brute_force(spark, monkeypatch, k, threshold, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "BLOCK_TOKENS", block * 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("mine") for c in ("row", "n", "node", "own", "bucket", "kept", "component_id", "tokens")})
    got = near_duplicates(docs, k, threshold)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, *threshold)


def test_coordinates_estimate_the_similarity_without_bias():
    rng = np.random.default_rng(2)
    for shared in (20, 60, 90):
        agreed = []
        for _ in range(60):
            tokens = rng.integers(0, 2**63, 200 - shared, dtype=np.int64).view(np.uint64)
            a, b = tokens[:100], tokens[100 - shared :]
            s = signatures(places(np.concatenate([a, b])), np.array([0, 100]), 160)
            agreed.append((s[0] == s[1]).mean())
        similarity = shared / (200 - shared)
        assert abs(np.mean(agreed) - similarity) < 4 * np.sqrt(similarity * (1 - similarity) / 160 / 60)


def test_the_second_permutation_is_one_to_one_and_bands_suffice():
    place = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    starts = np.arange(len(place))
    assert len(np.unique(signatures(place, starts, 1))) == len(place)
    # shifting by one is the next coordinate
    assert (signatures(place + np.uint32(1), starts, 1)[:, 0] == signatures(place, starts, 2)[:, 1]).all()
    assert n_bands((4, 5)) == 40


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()] == [(4, 0, 4, True)]
