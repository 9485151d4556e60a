"""The stages of the corpus pipeline, one after the other, on a small table with planted cases."""

import random

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from rowsheaf.llm import ngram_join


def test_stages_drop_what_they_should_and_nothing_else(spark, tmp_path):
    rng = random.Random(4)
    words = {"en": [f"en{c}word" for c in "abcdefghijklmnopqrstuv"], "fr": [f"fr{c}mot" for c in "abcdefghijklmnopqrstuv"]}
    prose = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    texts = [prose(lang, 80) for lang in ("en", "fr") for _ in range(15)]
    passage = prose("en", 40)
    texts += [texts[0] + " end", prose("en", 50) + " " + passage, "1234 5678", None, texts[3]]
    texts = [t if i > 14 else f"{t}\nAccept all cookies" for i, t in enumerate(texts)]
    rows = [(i, t, "fr" if 15 <= i < 30 else "en", f"s{i % 12}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(range(35)) - set(kept["language_id"]) == {32, 33}
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    assert "cookies" in kept["line_dedup"][0].text and "cookies" not in kept["line_dedup"][5].text
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["line_dedup"]) - set(kept["ngram_join"]) == {30, 34}
    assert set(kept["ngram_join"]) - set(kept["decontamination"]) == {31}
    assert set(kept["byte_bpe"]) == set(kept["decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["byte_bpe"])


def test_copies_over_many_sources_are_one_document(spark, tmp_path):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(12))
    copied, near = [line() for _ in range(8)], [line() for _ in range(12)]
    texts = ["\n".join([line(), "Accept all cookies", line()]) for _ in range(14)]
    texts += ["\n".join(copied)] * 20
    texts += ["\n".join([*near, f"own{i} end"]) for i in range(20)] + ["Accept all cookies"]
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, line())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {*range(14), 14, 34}
    cleaned = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    cleaned = {r.doc_id: r.text for r in cleaned.collect()}
    assert [i for i in range(14) if "cookies" in cleaned[i]] == [0]
    assert all(cleaned[i] == texts[i] for i in range(14, 54)) and 54 not in cleaned


def test_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(n))
    passage, shared = prose(40), prose(60)
    texts = [(None, prose(50)), (7, shared), (7, shared), (7, prose(30)), (None, shared), (8, passage), (8, prose(45)), (None, passage), (9, prose(40))]
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert len(kept) == 6 and kept.count((7, shared)) == 1 and (None, texts[0][1]) in kept and (7, texts[3][1]) in kept
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark_text(spark, docs, str(tmp_path)).collect()]
    assert len(kept) == 7 and (8, texts[6][1]) in kept and (None, passage) not in kept
    found = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == [7, 7, 8, 9, None]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_copies_are_not_multiplied_before_the_line_dedup(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(30))
    shared, ends = "\n".join([line(), line(), line()]), [f"one end {i}" for i in range(2)]
    texts = [f"{shared}\n{ends[i % 2]}" for i in range(120)]
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    materialise, written = ngram_join.materialise, {}

    def counted(df, label):
        table = materialise(df, label)
        written[label] = max(written.get(label, 0), table.count())
        return table

    monkeypatch.setattr(ngram_join, "materialise", counted)
    cleaned = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in cleaned.collect()} == dict(enumerate(texts))
    # two texts: their shared tokens, once for each, not for each pair of copies
    assert 0 < written["join-shared"] < 200 and written["join-star-sets"] <= 2


def test_a_stage_gives_its_workers_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    stage = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs)
    try:
        for given, most in (("10000", 1000), ("0", 1000), ("50", 50)):
            spark.conf.set(setting, given)
            docs = stage(spark, spark.range(0, 3000, 1, 1), "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
            assert {r.n for r in sizes.collect()} == {most}
    finally:
        spark.conf.set(setting, before)
