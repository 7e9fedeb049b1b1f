"""The stages one after another, against plain Python where a decision can be said in it."""

from collections import Counter

import corpus_pipeline
from ruleweave.llm import langid
from tests.llm.test_operators import DATA, SCHEMA, docs_of, plain_set, rows  # noqa: F401


def test_exact_stage(spark, rows):  # noqa: F811
    got = corpus_pipeline.one_of_equal(spark, docs_of(spark, rows), DATA)
    texts = [" ".join((t or "").encode().decode().replace("\xa0", "\0").replace(" ", "\1").replace("\x1c", "\2").split()) for _, t in rows]
    lead = [bool(t) and t[0] in " \t\n\r\v\f" for _, t in rows]
    trail = [bool(t) and t[-1] in " \t\n\r\v\f" for _, t in rows]
    keys = Counter(zip(texts, lead, trail))
    assert got.count() == len(keys) and "id_" in got.columns


def test_near_stage_and_filters(spark):
    base = " ".join(f"word{i} the" for i in range(60))
    made = [(1, base), (2, base + " more"), (3, "other words entirely here now"), (4, None), (5, "12 34")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near(spark, docs, DATA).collect()) == [1, 3, 4, 5]
    train = spark.createDataFrame([(i, "the thing here and there", "en", "s", 0) for i in range(10)], SCHEMA)
    kept = corpus_pipeline.known_language(spark, docs.unionByName(train), DATA)
    assert {r.doc_id for r in kept.collect()} == set(range(10))
    assert kept.columns == docs.columns and kept.filter("text is null or text = '12 34'").count() == 0


def test_language_stage_drops_strange_scripts(spark):
    made = [(1, "слово и ещё слова"), (2, "the thing слово и ещё слова"), (3, "the thing here and слово"), (4, "中文")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in made] + [(10 + i, "the thing here and there", "en", "s", 0) for i in range(10)], SCHEMA)
    kept = corpus_pipeline.known_language(spark, docs, DATA)
    assert {r.doc_id for r in kept.collect()} == {3, *range(10, 20)}
    told = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.identify(docs).collect()}
    assert [told[i] for i in (1, 2, 3, 4)] == [("und", False)] * 2 + [("en", True), ("und", False)]


def test_whole(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = [plain_set(texts[i]) for i in ids]
    assert 0.6 * docs.count() <= len(ids) <= docs.count()
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
