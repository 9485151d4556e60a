"""The training-data operators against brute force, round trips and planted cases, with nulls, ties and empty tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rowsheaf.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    nearest,
    ngram_join,
    pii,
)
from rowsheaf.llm.components import connected
from rowsheaf.llm.text import WHITE_SPACE, WordHasher, frequent
from rowsheaf.plans.files import materialise

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog walked to the old house near the river while it was raining"
FR = "le chat et le chien sont dans la vieille maison avec une rivière près de nous"


def docs_of(spark, texts, lang=None, source=None, **extra):
    rows = [(i, t, lang and lang[i], (source or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    # names the operators use inside must not clash with a user's
    return df.withColumns({c: F.lit("mine") for c in ("_id", "_row", "token", "n", "h", "site", "place", "held_out", "score", "word")} | extra)


HARD = [None, "", "   \n\t ", "a", EN, EN, EN.upper(), "x" * 200_000, "word " * 40_000, " ", "é" * 300, EN + " extra"]


# ---------------------------------------------------------------- words and components


def test_word_hashes_tell_words_apart_and_fold_ascii_case():
    texts = ["The the tHE", "", "b a\x0bb c  É é", "a b"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes, rows, starts, ends = WordHasher(WHITE_SPACE).words(data, offsets)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert [bytes(data[s:e]).lower() for s, e in zip(starts, ends)] == words
    assert rows.tolist() == [i for i, t in enumerate(texts) for _ in t.encode().split()]
    by_hash = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(words))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "src long, dst long"), "t").collect()}
    assert found == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "src long, dst long"), "t").isEmpty()


def test_frequent_is_bounded(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 5, 5, 3, 1, 0])], "k long, n long")
    assert {r.k for r in frequent(counts, "n", 3).collect()} == {0, 1, 2}
    assert frequent(counts, "n", 0).isEmpty()


# ---------------------------------------------------------------- 1: scoring


def test_scores_against_brute_force(spark):
    rng = random.Random(5)
    texts = HARD + [" ".join(rng.choices(EN.split() + FR.split() + ["qzx"], k=rng.randrange(1, 60))) for _ in range(60)]
    for shared in (1 << 18, 3):  # all words shared, and nearly all joined
        got = lm_scoring.score_documents(docs_of(spark, texts), RANKS, PATTERN, (7, 2), shared_words=shared).collect()
        assert len(got) == len(texts)
        tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
        out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
        counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
        n, v = sum(counts.values()), len(counts)
        for r in got:
            ws = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (out[r.doc_id], len(ws), n)
            assert r.n_known == sum(counts[w] > 0 for w in ws)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
            assert math.isfinite(r.score) and r.score < 0


def test_lattice_sums_all_segmentations():
    scores = {e: math.log(p) for e, p in [(b"a", 0.2), (b"b", 0.1), (b"ab", 0.3), (b"ba", 0.05), (b"aba", 0.01)]}
    lattice = lm_scoring.Lattice(scores)
    word = b"abaab"
    total, uses = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores for p in parts):
            p = math.exp(sum(scores[x] for x in parts))
            total += p
            for x in parts:
                uses[x] += p
    assert lattice.log_probability(word) == pytest.approx(math.log(total))
    expected = Counter()
    for entry, share in lattice.expected(word):
        expected[entry] += share
    assert {k: v for k, v in expected.items() if v} == pytest.approx({k: v / total for k, v in uses.items()})
    assert lattice.log_probability(b"c") == -math.inf and list(lattice.expected(b"c")) == []
    assert lattice.log_probability(word, 0.5) == pytest.approx(math.log(total + 0.5))
    assert lattice.log_probability(b"") == 0.0


def test_lattice_of_a_very_long_word_keeps_a_window_only():
    scores = {e: math.log(p) for e, p in [(b"a", 0.5), (b"b", 0.125), (b"ab", 0.25), (b"abab", 0.125)]}
    lattice = lm_scoring.Lattice(scores)
    word = b"ab" * 500_000
    tracemalloc.start()
    found = lattice.log_probability(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # by the recurrence of a pair: p(n) = (0.5 * 0.125 + 0.25) p(n - 1) + 0.125 p(n - 2)
    pair, growth = 0.5 * 0.125 + 0.25, (0.3125 + math.sqrt(0.3125**2 + 0.5)) / 2
    low = pair - growth
    assert found == pytest.approx(500_001 * math.log(growth) - math.log(growth - low), rel=1e-9)
    assert peak < 1 << 20
    short = word[:2000]
    uses = Counter()
    for entry, share in lattice.expected(short):
        uses[entry] += share
    assert sum(len(e) * n for e, n in uses.items()) == pytest.approx(len(short))
    again = Counter()
    lattice._KEPT = 10
    for entry, share in lattice.expected(short):
        again[entry] += share
    assert again == pytest.approx(uses)


def test_lattices_of_many_words_are_those_of_each():
    rng = random.Random(8)
    scores = {e: math.log(p) for e, p in [(b"a", 0.2), (b"b", 0.1), (b"ab", 0.3), (b"ba", 0.05), (b"aba", 0.01), (b"bcab", 0.02), (b"a" * 70, 0.1)]}
    entries = {e: 2 * i for i, e in enumerate(scores)}  # not all numbers are used
    by_number = np.full(20, -math.inf)
    by_number[list(entries.values())] = list(scores.values())
    words = [bytes(rng.choices(b"abc" if i % 5 else b"ab", k=rng.randrange(1, 20))) for i in range(300)] + [b"ab" * 31, b"ab" * 32, b"ab" * 33, b"a" * 150, b"c"]
    own = np.array([rng.choice([0.0, -0.5, 1e-9, 0.3]) for _ in words])
    one, many = lm_scoring.Lattice(scores), lm_scoring.Lattices(entries, lm_scoring.Trie(entries), by_number)
    assert many.log_probabilities(words, own).tolist() == pytest.approx([one.log_probability(w, o) for w, o in zip(words, own)])
    uses = np.zeros(20)
    for word in words:
        for entry, share in one.expected(word):
            uses[entries[entry]] += share
    assert many.expected(words).tolist() == pytest.approx(uses.tolist()) and uses[entries[b"bcab"]] > 0 < uses[entries[b"a" * 70]]
    assert many.expected([]).sum() == 0 and len(many.log_probabilities([], np.zeros(0))) == 0


def test_lattices_of_many_words_take_less_time_than_one_by_one():
    rng = random.Random(9)
    ranks, trie = lm_scoring._vocabulary(RANKS), lm_scoring._trie(RANKS)
    scores = np.full(max(ranks.values()) + 1, math.log(1 / len(ranks)))
    words = [b" " + "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(1, 14))).encode() for _ in range(10_000)]
    many, one = lm_scoring.Lattices(ranks, trie, scores), lm_scoring.Lattice({e: scores[i] for e, i in ranks.items()})
    start = time.process_time()
    fast = many.expected(words), many.log_probabilities(words, np.zeros(len(words)))
    middle = time.process_time()
    slow = Counter(e for w in words for e, _ in one.expected(w)), [one.log_probability(w) for w in words]
    assert fast[1].tolist() == pytest.approx(slow[1]) and set(np.flatnonzero(fast[0])) == {ranks[e] for e in slow[0]}
    assert (middle - start) * 2 < time.process_time() - middle


# ---------------------------------------------------------------- 2: decontamination


def test_tiling_finds_reordered_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]
    reordered = noise(50) + item[20:] + noise(30) + item[:20] + noise(50)
    a_bit = noise(60) + item[:12] + noise(60)
    texts = [" ".join(reordered).upper(), " ".join(a_bit), ", ".join(item), " ".join(noise(300)), None, "", " ".join(item * 30)]
    bench = spark.createDataFrame([(5, " ".join(item), "x"), (6, None, "x"), (7, "too short", "x")], "item_id long, text string, doc_id string")
    rows = decontamination.contaminated(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id, r.covered_words, r.n_tiles) for r in rows} == {(0, 5, 40, 2), (2, 5, 40, 1), (6, 5, 40, 1)}
    assert decontamination.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs_of(spark, []), bench).count() == 0


def test_long_repetitions_hold_each_seed_once(spark):
    phrase = "one two three four five six"
    texts = [f"{phrase} " * 2_000, EN]
    bench = spark.createDataFrame([(i, phrase if i % 2 else f"{phrase} seven eight") for i in range(40)], "item_id long, text string")
    rows = decontamination.contaminated(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in rows} == {(0, i, 6 if i % 2 else 8, 6) for i in range(40)}


def test_short_items_are_found_whole(spark):
    texts = ["Who wrote Hamlet, then?", "who wrote it", "before WHO WROTE HAMLET THEN after", "who wrote hamlet", None, "", "yes", "hamlet " * 5]
    items = [(1, "Who wrote Hamlet then"), (2, "yes"), (3, "yes"), (4, ""), (5, None), (6, "hamlet hamlet")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(docs_of(spark, texts).withColumnRenamed("doc_id", "item_id"), bench, id_col="item_id").collect()
    assert {(r.doc_item_id, r.item_id, r.item_words, r.covered_words, r.doc_words) for r in rows} == {
        (0, 1, 4, 4, 4), (2, 1, 4, 4, 6), (6, 2, 1, 1, 1), (6, 3, 1, 1, 1), (7, 6, 2, 2, 5)
    }


def _covered_one_by_one(doc, item, least):
    """Greedy tiling as first written down: the longest common run of unmarked words, one after the other."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            free_d[i + k] = free_i[j + k] = False
        covered += n


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randrange(2, 40))] for _ in range(25)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            item = rng.choice(items)
            at = rng.randrange(len(item))
            text += item[at : at + rng.randrange(1, 30)] + [rng.choice(words) for _ in range(rng.randrange(6))]
        texts.append(text)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, [" ".join(t) for t in texts]), bench).collect()
    expected = set()
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            if len(item) < decontamination.MIN_MATCH:
                if any(text[a : a + len(item)] == item for a in range(len(text))):
                    expected.add((d, k, len(item)))
            elif (n := _covered_one_by_one(text, item, decontamination.MIN_MATCH)) >= decontamination.COVERAGE * len(item):
                expected.add((d, k, n))
    assert {(r.doc_id, r.item_id, r.covered_words) for r in got} == expected and len(expected) > 30


def test_tiles_are_greedy_and_do_not_overlap():
    rng = np.random.default_rng(1)
    for _ in range(30):
        doc, item = rng.integers(0, 3, 60).astype(np.uint64), rng.integers(0, 3, 40).astype(np.uint64)
        tiles = decontamination.tile(doc, item, 4)
        for n, i, j in tiles:
            assert n >= 4 and (doc[i : i + n] == item[j : j + n]).all()
        for k in (1, 2):
            places = [p for t in tiles for p in range(t[k], t[k] + t[0])]
            assert len(places) == len(set(places))
        longest = max((n for i in range(60) for j in range(40) if (n := next((k for k in range(41) if i + k >= 60 or j + k >= 40 or doc[i + k] != item[j + k]), 0))), default=0)
        assert not tiles or longest < 4 or max(t[0] for t in tiles) == longest or longest <= 20


# ---------------------------------------------------------------- 3: line dedup


def test_wide_lines_stay_only_where_they_come_first(spark):
    texts = [f"Own line {i}\nShared  Footer\n\nlast {i}" for i in range(12)] + ["narrow\nown"] * 3 + [None, "", "shared footer\nShared Footer"]
    source = {i: f"site{i % 10}" for i in range(12)} | {12: "a", 13: "b", 14: None, 17: "site1"}
    docs = docs_of(spark, texts, source=source, n_removed=F.lit(9))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, min_sites=10).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    for i in range(1, 12):
        assert (got[i].text, got[i].n_removed) == (f"Own line {i}\n\nlast {i}", 1)
    assert [got[i].text for i in range(12, 18)] == ["narrow\nown"] * 3 + [None, "", ""]
    assert line_dedup.drop_boilerplate(docs, min_sites=11).where("n_removed > 0").count() == 0
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_lines_are_compared_as_spark_would_lower_and_trim_them(spark):
    words = ["ΟΔΟΣ", "Σ", "ΑΣ.", "İstanbul", "ẞ ß", "É", "ǅ", "a\u00a0b", "\t x\x0b \fY\r", "  ", " \t", "", "\u2003Z", "Ω  \t Ω", "𐐀", "x" * 300]
    text = "\n".join([*words, *[f"{a} {b}" for a in words for b in words]])
    norm = F.lower(F.trim(F.regexp_replace("line", "[ \\t\\r\\f\\x0B]+", " ")))
    rows = spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", "\n")).alias("place", "line"))
    assert line_dedup._norm(text) == [r.line for r in rows.orderBy("place").select(norm.alias("line")).collect()]


def test_lines_are_made_and_cut_in_slices_outside_the_jvm(spark, monkeypatch):
    texts = [f"own {i}\nAccept all\tcookies\n" + f"word{i} " * 40_000 for i in range(12)] + [None, ""]
    docs = docs_of(spark, texts, source={i: f"site{i}" for i in range(12)}).coalesce(1)
    tasks, mapped = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: tasks.append((run, df)) or mapped(df, run, schema))
    cleaned = line_dedup.drop_boilerplate(docs)
    got = {r.doc_id: (r.text, r.n_removed) for r in cleaned.collect()}
    assert got == {i: (t if not t or i == 0 else t.replace("Accept all\tcookies\n", ""), int(bool(t) and i > 0)) for i, t in enumerate(texts)}
    assert len(tasks) == 2
    for run, given in tasks:
        # one large batch, as a task gets it, comes back in slices; and no line is made by a higher-order function before it
        assert "lambda" not in given._jdf.queryExecution().optimizedPlan().toString()
        parts = list(run(iter(given.toArrow().combine_chunks().to_batches())))
        assert len(parts) >= 3 and sum(p.num_rows for p in parts) == len(texts)
        assert max(p.num_rows for p in parts) <= 6


def test_few_and_many_wide_lines_give_the_same_texts(spark):
    rng = random.Random(3)
    lines = ["Home\t |  News", "home | news", "ΟΔΟΣ", "οδος", "", " \t ", "Own line", "all  rights RESERVED", "\r"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(8)) + [f"own {i % 30}"]) for i in range(60)] + [None, "", "\n\n"]
    docs = docs_of(spark, texts, source={i: f"s{i % 13}" for i in range(60)})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 9 != 4, F.col("doc_id") % 50)).withColumn("_hash", F.lit(1))
    few, many = (sorted(map(repr, line_dedup.drop_boilerplate(docs, min_sites=4, most=most).collect())) for most in (1 << 20, 0))
    assert few == many and any("n_removed=3" in r for r in few)


# ---------------------------------------------------------------- 4: nearest neighbours


def test_nearest_with_ties_zeros_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 12))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1003, [None] + [1.0] * 11), (None, [1.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    queries = table.where("vec_id % 20 = 0")
    got = {}
    for r in nearest.nearest(table, queries, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:7]
        assert len(found) == 7 and all(abs(s[i] - v) < 1e-9 for i, v in found)
        hit += len(set(order) & {i for i, _ in found})
    assert hit >= 0.9 * 7 * len(got)
    assert [i for i, _ in got[100]][:3] == [101, 102, 103]
    few = nearest.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"), k=7)
    assert {r.vec_id for r in few.collect()} == {1, 2}
    assert nearest.nearest(table.limit(0), table).count() == 0


def test_chi_square_quantile():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# ---------------------------------------------------------------- 5: similarity join


def _components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i, j in itertools.combinations(range(len(texts)), 2):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return [(len(s), c) for s, c in zip(sets, label)]


@pytest.mark.parametrize("k,threshold,block", [(4, (17, 20), 256), (5, (4, 5), 256), (4, (17, 20), 4)])
def test_similarity_join_against_all_pairs(spark, monkeypatch, k, threshold, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LARGE", max(2, block // 4))
    rng = random.Random(11)
    texts = list(HARD[:-1])
    for _ in range(6):
        base = rng.choices([f"w{i}" for i in range(400)], k=rng.randrange(8, 120))
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(own))
    texts += [texts[20]] * 3
    got = ngram_join.similar_components(docs_of(spark, texts), k, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(_components(texts, k, *threshold)))


def test_similarity_join_of_nothing(spark):
    assert ngram_join.similar_components(docs_of(spark, [])).count() == 0
    rows = ngram_join.similar_components(docs_of(spark, [None, ""])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, 0, 0), (1, 0, 1)]


def test_join_tells_rows_with_one_id_apart(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, "alone here and nowhere else at all"), (None, None), (9, ""), (9, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(0)).withColumn("id", F.lit("x"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect())
    assert got == Counter(
        [(1, 26, 1), (1, 26, 1), (2, 26, 1), (3, 26, 1), (None, 26, 1), (None, 3, None), (None, 0, None), (9, 0, 9), (9, 1, 9)]
    )
    c = " ".join(f"c{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (5, b), (0, a), (7, c)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert got == {(1, 0), (1, 1), (5, 1), (0, 0), (7, 7)}



# ---------------------------------------------------------------- 6: byte-level BPE


def test_encoding_equals_the_library_and_decodes(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*HARD, "I'll  say 'tis\n\n 12abc34 <|endoftext|> 日本語 🙂 x ", ("it's 9am \n" + "ab12" * 10) * 4000, "1a" * 70_000]
    rows = byte_bpe.encode_documents(docs_of(spark, texts), RANKS, PATTERN)
    for r in byte_bpe.decode_ids(rows, RANKS, PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows.count() == len(texts)


# ---------------------------------------------------------------- 7: language identification


def test_languages_by_known_words_then_by_grams(spark):
    texts = [EN, FR] * 20
    model = language_id.train(docs_of(spark, texts + [EN, None], lang=["en", "fr"] * 20 + [None, "en"]))
    ask = ["the house", "la maison", "walkings rainy", "chiennes vieilles", None, "", "123 -- 4", EN + " " + EN]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, ask), model).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["en", "fr", "en", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.train(docs_of(spark, [None]))
    assert [r.lang_pred for r in language_id.identify(docs_of(spark, [EN]), nothing).collect()] == ["und"]


def test_languages_do_not_depend_on_what_is_broadcast(spark):
    rng = random.Random(6)
    made = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(n))
    texts = [made("abcdefgh", 30) if i % 2 else made("efghijkl", 30) for i in range(40)]
    labelled = docs_of(spark, texts, lang=["en" if i % 2 else "fr" for i in range(40)])
    ask = docs_of(spark, [*texts[:8], *(made("abcdefghijklmn", 4) for _ in range(30)), "zzz", None, "zzz"])
    ask = ask.unionByName(ask.where("doc_id < 2")).unionByName(ask.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    found = []
    for words, grams in ((1 << 17, 1 << 17), (40, 60), (0, 0)):
        model = language_id.train(labelled, words=words, grams=grams)
        rows = language_id.identify(ask, model, keep=["text"]).collect()
        found.append(sorted((str(r.doc_id), str(r.text), r.lang_pred, round(r.score, 9)) for r in rows))
    assert len(found[0]) == ask.count() and found[0] == found[1] == found[2]


def test_languages_shuffle_words_once(spark, monkeypatch):
    plans = []

    def written(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return materialise(df, label)

    monkeypatch.setattr(language_id, "materialise", written)
    # a label of texts without a letter is no language
    model = language_id.train(docs_of(spark, [EN, FR, "12 -- 3"] * 3, lang=["en", "fr", "aa"] * 3), words=20, grams=20)
    assert model.languages == ["en", "fr"]
    assert sum(n for _, n in plans) == 2  # words, and n-grams
    plans.clear()
    got = language_id.predictions(docs_of(spark, [EN, FR + " qqq zzz zzz"]), model)
    # the words of texts, the counts they meet, and the sums by text; the others come from rows of words never learned only
    assert dict(plans)["language-found"] <= 3 and sum(n for _, n in plans) <= 4
    assert sorted(r.lang_pred for r in got.collect()) == ["en", "fr"]


# ---------------------------------------------------------------- 8: licences


def test_licenses_by_line_and_over_lines(spark):
    mit = [s for s, i in license_scan.SENTENCES.items() if i.startswith("MIT") and i != "MITRef"]
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore prose. All Rights Reserved.",
        ("\n".join(". ".join(mit).split(" the "))).replace("\n", " the\n") + ".",
        "/* Licensed under the Apache License,\n Version 2.0 (the \"License\");\n you may not use this file except in compliance\n"
        " with the License. You may obtain a copy of the License at: x */",
        "the license of the cat", None, "",
    ]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT,Proprietary", "MIT", "Apache-2.0", "", "", ""]


# Sentences as they are really written, where they differ from the stored ones in more than their first letter and last stop.
WORDINGS = {
    "licensed under the apache license version 2.0": "Licensed under the Apache License, Version 2.0.",
    "licensed under the apache license version 2.0 the license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "You may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0",
    "this program is free software": "This program is free software: you",
    "this library is free software": "This library is free software; you",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "spdx-license-identifier mit": "// SPDX-License-Identifier: MIT",
    "spdx-license-identifier apache-2.0": "# SPDX-License-Identifier: Apache-2.0",
    "spdx-license-identifier gpl-3.0-only": "/* SPDX-License-Identifier: GPL-3.0-only */",
    "spdx-license-identifier gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "all rights reserved": "All rights\nreserved.",
}
LATER = (
    "This {} is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public\nLicense as published by"
    " the Free Software Foundation{} either\nversion {} of the License, or (at your option) any later version.\n\nThis program is distributed"
)
HEADERS = {
    LATER.format("program", ":", "", ",", "3"): "GPL-3.0-or-later",
    LATER.format("program", ";", "", ";", "2"): "GPL-2.0-or-later",
    LATER.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not": "MPL-2.0",
}


def test_licenses_in_their_original_wording(spark):
    sentences = [(WORDINGS.get(s, s.capitalize() + "."), i) for s, i in license_scan.SENTENCES.items()]
    rules = []
    for name, ids in license_scan.RULES:
        own = [next(WORDINGS.get(s, s.capitalize() + ".") for s, i in license_scan.SENTENCES.items() if i == k) for k in ids]
        rules.append(("\n".join(w.removesuffix(" you") for w in own), name))
    texts = [t for t, _ in [*sentences, *rules, *HEADERS.items()]]
    texts = [t.removesuffix(" you") for t in texts]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    n, m = len(sentences), len(sentences) + len(rules)
    assert [got[i].sentence_ids for i in range(n)] == [i for _, i in sentences]
    assert [got[i].licenses for i in range(n, len(texts))] == [name for _, name in [*rules, *HEADERS.items()]]
    assert all(got[i].unmatched == "" for i in range(n, m))


def test_licenses_by_line_beside_wrapped_ones(spark):
    wrapped = "This work is licensed under the GNU General\nPublic License, version 3."
    texts = [
        f"Licensed under the MIT License\nCopyright 2020 A\n\n{wrapped}",
        f"{wrapped}\n\nLicensed under the MIT License\nUnlicensed things\nAll rights reserved\nLicensed under CC BY 4.0\n",
        f"{wrapped}\r\nReleased under the MIT License\r\nAll rights\r\nreserved",
        "This work is licensed under the GNU General\n\nPublic License, version 3.",
    ]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert got[0] == ("MITRef GPL3Ref", "GPL-3.0,MIT")
    assert got[1] == ("GPL3Ref MITRef AllRights CCBYRef", "GPL-3.0,MIT,CC-BY-4.0,Proprietary")
    assert got[2] == ("GPL3Ref MITRef AllRights", "GPL-3.0,MIT,Proprietary")
    assert got[3] == ("", "")


def test_licenses_of_marked_and_distant_sentences(spark):
    later = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    later += " Software Foundation, either version 3 of the License, or (at your option) any later version."
    between = " ".join(["word"] * 50)
    texts = [
        "-- Licensed under the Apache\n-- License, Version 2.0\n",
        " * Released under the MIT\n *   License.\n%% SPDX-License-Identifier: GPL-3.0+\n--All rights\n--reserved.--",
        f"This program is free software.\nLicensed under the Apache License, Version 2.0.\n{between}\n{later}",
        f"This program is free software:\n{later}\nThis program is free software.\n{between}.\n{later}",
        "Licensed under the MIT License of old. Licensed under CC0 1.0",
        "a" + "." * 1_000_000 + "b under " + "-" * 1_000_000 + "\nAll rights reserved " + "\n " * 500_000,
        "Available under a zlib license; under", None, "", "\x02 \x03 all rights reserved", "ALL RIGHTS RESERVED...!",
    ]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i].licenses for i in range(5)] == [
        "Apache-2.0", "GPL-3.0-or-later,MIT,Proprietary", "Apache-2.0", "GPL-3.0-or-later", "CC0-1.0",
    ]
    assert [got[i].unmatched for i in range(5)] == ["", "", "FreeProgram GPL3Later", "FreeProgram GPL3Later", ""]
    assert [got[i].licenses for i in range(5, 11)] == ["Proprietary", "Zlib", "", "", "Proprietary", "Proprietary"]
    assert all(any(h in s for h in license_scan._HINTS) for s in license_scan.SENTENCES)
    twice = license_scan.scan_licenses(docs.unionByName(docs).withColumn("found", F.lit(1))).count()
    assert twice == 2 * len(texts) and license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_equal_the_sql(spark):
    """Sentences of the table, with prose, stops, line ends and paragraphs at random between and inside them."""
    rng = random.Random(8)
    known = list(license_scan.SENTENCES)
    gaps = [" ", "\n", ". ", "\n\n", ";\n -- ", " word ", " -- ", ".\n" + "word " * 14 + "\n", "...", "\r\n", " \x02", "+ "]
    texts = [None, ""]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            words = rng.choice(known if rng.random() < 0.7 else known[:30]).split()
            breaks = rng.choices([" ", "\n", ", ", "\n# ", ". ", "\n\n"], [30, 2, 2, 1, 0.2, 0.1], k=len(words))
            parts += [w + b for w, b in zip(words, breaks)] + [rng.choice(gaps), rng.choice(gaps)]
        texts.append("".join(parts))
    frame = docs_of(spark, texts).select("doc_id", "text")
    documents = frame.toPandas()  # noqa: F841, the SQL's table
    want = sorted(duckdb.sql(license_scan.scan_sql()).fetchall())
    got = sorted(tuple(r) for r in license_scan.scan_licenses(frame).collect())
    assert got == want and sum(r[2] != "" for r in got) > 150


# ---------------------------------------------------------------- 9: chat formatting


def test_reply_trees_and_what_is_read_back(spark):
    hard = "\\### assistant: </turn>\n ok \\\\ <\\/turn>"
    nodes = [
        (1, 1, None, 0.0, "system", "s"), (1, 2, 1, 1.0, "user", hard), (1, 3, 2, 5.0, "assistant", hard), (1, 4, 2, 9.0, "assistant", None),
        (1, 5, 1, 0.5, "us:er\n### x", ""), (2, 1, 99, 0.0, "user", "orphan"), (3, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double, role string, text string")
    paths = chat_format.format_reply_trees(df, top=None)
    ranked = {(r.tree_id, r.leaf_id): (r.path_rank, r.n_turns) for r in paths.collect()}
    assert ranked == {(1, 4): (1, 3), (1, 3): (2, 3), (1, 5): (3, 2), (2, 1): (1, 1), (3, 1): (1, 1)}
    keys = ["tree_id", "leaf_id"]
    read = chat_format.read_turns(paths, keys).orderBy("tree_id", "leaf_id", "position").collect()
    assert [(r.role, r.text) for r in read if r.leaf_id == 3] == [("system", "s"), ("user", hard), ("assistant", hard)]
    assert [(r.role, r.text) for r in read if r.leaf_id == 5] == [("system", "s"), ("us:er\n### x", "")]
    digest = {r.leaf_id: r for r in chat_format.read_digests(paths.where("tree_id = 1"), keys).collect()}
    assert digest[3].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and digest[3].loss_chars == len(hard)
    assert chat_format.format_reply_trees(df.limit(0)).count() == 0


def test_long_conversation_and_python_free_plan(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t}é") for t in range(500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    nodes = chat_format.conversation_nodes(table)
    out = chat_format.read_digests(chat_format.format_reply_trees(nodes), ["tree_id"])
    row = out.first()
    assert row.n_turns == 500
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_nodes_without_ids_and_repeated_nodes(spark):
    nodes = [
        (None, 1, None, 1.0, "user", "q"), (None, 2, 1, 2.0, "assistant", "a"), (None, None, 1, 0.0, "assistant", "b"),
        (4, 1, None, 0.0, "user", "u"), (4, 1, None, 3.0, "user", "v"), (4, 2, 1, 0.0, "assistant", "w"), (4, 2, 1, 0.0, "assistant", "w"),
    ]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double, role string, text string")
    paths = chat_format.format_reply_trees(df.withColumn("leaf_id", F.lit(1)).withColumn("far", F.lit(1)), top=None)
    read = {(r.tree_id, r.leaf_id): (r.path_rank, r.formatted) for r in paths.collect()}
    assert read == {
        (None, 2): (1, "### user: q</turn>\n### assistant: a</turn>\n"),
        (None, None): (2, "### user: q</turn>\n### assistant: b</turn>\n"),
        (4, 2): (1, "### user: u</turn>\n### user: v</turn>\n### assistant: w</turn>\n### assistant: w</turn>\n"),
    }


@pytest.mark.parametrize("parents", [{1: 1}, {1: 2, 2: 1}, {1: 2, 2: 1, 3: 2}, {1: 3, 2: 1, 3: 2, 4: 1, 5: 4, 6: None}])
def test_a_cycle_of_replies_raises(spark, parents):
    rows = [(1, k, p, 0.0) for k, p in parents.items()]
    with pytest.raises(ValueError, match="cycle"):
        chat_format.reply_paths(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double"))


def test_paths_equal_a_walk_from_every_leaf(spark):
    rng = random.Random(9)
    rows = [(t, k, rng.choice([None, *range(k)]) if k else None, rng.choice([None, 0.25, 1.0, 4.0])) for t in range(12) for k in range(rng.randrange(1, 40))]
    rows += [(99, k, k - 1 if k else None, 0.5) for k in range(130)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double").repartition(3)
    tree = {(t, k): (p, s or 0.0) for t, k, p, s in rows}
    parents = {(t, p) for (t, _), (p, _) in tree.items()}
    expected = set()
    for t in {r[0] for r in rows}:
        walks = []
        for t2, k in tree:
            if t2 == t and (t, k) not in parents:
                walk, at = [], k
                while at is not None:
                    walk.append(at)
                    at = tree[t, at][0]
                walks.append((-sum(tree[t, n][1] for n in walk) / len(walk), k, walk[::-1]))
        for rank, (_, leaf, walk) in enumerate(sorted(walks)[:2], 1):
            expected |= {(t, leaf, rank, d, n) for d, n in enumerate(walk)}
    assert {tuple(r) for r in chat_format.reply_paths(df, top=2).collect()} == expected


def test_rows_without_a_conversation_are_one_conversation(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", None), (3, 0, "user", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (5, 0, None, "z" * 300_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node_id", F.lit(1))
    formatted = chat_format.format_reply_trees(chat_format.conversation_nodes(table)).withColumnRenamed("tree_id", "conv_id")
    got = {r.conv_id: r for r in chat_format.read_digests(formatted, ["conv_id"]).collect()}
    turns = {None: [("user", ""), ("assistant", "b")], 3: [("assistant", "y"), ("assistant", "y"), ("user", "x")], 5: [("", "z" * 300_000)]}
    assert got.keys() == turns.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, listed in turns.items():
        lost = "".join(t for r, t in listed if r == "assistant")
        size = sum(len(f"### {r}: {t}</turn>\n") for r, t in listed)
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (len(listed), sha("".join(f"{a}\n{b}\n" for a, b in listed)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(lost), sha(lost), size)


# ---------------------------------------------------------------- 10: personal data


def _naive(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 16 <= len(d) <= 19 and (sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS.index(k), s, e) for k, s, e in found]


def test_base_spans_are_the_patterns_leftmost_matches():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices("a@.-+ 1234567890()é_%", k=rng.randrange(40)))
        assert pii.base_spans(text) == _naive(text)
    assert pii.base_spans("a@b.c@d.e x@y@z.w 4111 1111-1111 1111 +1 (555) 123-4567 256.1.1.1 1.2.3.4.5") == _naive(
        "a@b.c@d.e x@y@z.w 4111 1111-1111 1111 +1 (555) 123-4567 256.1.1.1 1.2.3.4.5"
    )


def test_classifier_adds_what_the_labelers_agree_on(spark):
    texts = [f"write to user{i}@mail.example.com or call +1 (212) 555-{1000 + i}" for i in range(60)]
    texts += ["contact: jane.doe [at] example [dot] com today", "phone 212-555-0199 now", "order 1234567890123456", None, "", "clean text at home"]
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    assert (got[0].n_email, got[0].n_phone, got[0].n_added) == (1, 1, 0)
    assert got[60].spans.startswith("email:9:") and got[61].spans == "phone:6:18"
    assert [got[i].spans for i in (62, 63, 64, 65)] == ["", "", "", ""]
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0
