"""Resampling by importance against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsheaf.llm.checksums import crc32_runs
from rowsheaf.llm.resampling import resample

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, share, longest, buckets, min_words):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(of, features(text, longest)[1]))
    for text in target:
        t.update(map(of, features(text, longest)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain(of(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words), len(found), weight, score])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = [(r, i + 1) for i, r in enumerate(able[: len(able) * share[0] // share[1]])]
    left = able[len(ranks) :] + [r for r in out if r[1] < min_words]
    return sorted([(*r, i) for r, i in ranks] + [(*r, None) for r in left], key=repr)


def corpus():
    rng = random.Random(5)
    names = ["alpha", "Beta", "gamma", "été", "x1", "O'Neil", "z" * 90, "日本"]
    rows = [(i, " ".join(rng.choices(names, k=rng.randrange(0, 30)))) for i in range(150)]
    rows += [(7, "alpha beta " * 15)] * 3 + [(None, "Beta gamma " * 20), (None, None), (200, None), (201, ""), (202, " \n.,")]
    return rows + [(300 + i, "alpha beta gamma " * 8) for i in range(80)] + [(400, "gamma " * 100_000), (401, "q" * 300_000)]


@pytest.mark.parametrize("longest, share, min_words, margin", [(1, (10, 100), 20, 0.002), (2, (1, 3), 0, 0.0), (3, (1, 1), 5, 0.05)])
def test_weights_scores_and_ranks_equal_brute_force(spark, longest, share, min_words, margin):
    rows, target = corpus(), ["alpha alpha été", None, "", "Gamma, x1 alpha"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.withColumns({c: F.lit("mine") for c in ("rank", "weight", "_id", "_text", "_nth", "bucket", "_tie")})
    bench = spark.createDataFrame([(t,) for t in target], "text string").withColumn("doc_id", F.lit(1))
    got = resample(docs, bench, share, longest, 500, min_words, margin=margin)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, share, longest, 500, min_words)


def test_columns_are_kept_and_clashes_raise(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 25, "s") for i in range(10)], "doc_id long, text string, _nth string")
    got = resample(docs, docs.select("text"), keep=["text", "_nth"])
    assert got.columns[:3] == ["doc_id", "text", "_nth"] and got.where("rank = 1 AND text LIKE 'w%'").count() == 1
    with pytest.raises(ValueError, match="rank"):
        resample(docs.withColumn("rank", F.lit(1)), docs, keep=["rank"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b " * 12) for i in range(20)], "doc_id long, text string")
    none = docs.where("false")
    assert resample(none, docs).count() == 0 and resample(none, none).count() == 0
    got = resample(docs, none).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2] and got[0]["score"] >= got[1]["score"]


def test_many_checksums_at_once_equal_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3800, 500)
    ends = starts + rng.integers(0, 150, 500)
    whole = crc32_runs(data, starts, ends)
    assert whole.tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends)]
    middle = (starts + ends) // 2
    assert crc32_runs(data, middle, ends, crc32_runs(data, starts, middle)).tolist() == whole.tolist()
