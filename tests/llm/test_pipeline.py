"""The pipeline's stages, one by one, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from abacist.llm import jaccard, langid, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, f in pipeline.STAGES[:-1]:
        out.append(f(spark, out[-1], SF).cache())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [k for k, _ in pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    for a, b in zip(stages, stages[1:]):
        assert a.dtypes == b.dtypes
        assert ids(b) <= ids(a)


def test_copies_go(stages):
    rows = stages[1].collect()
    last = {}
    for r in rows:
        key = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        last[key] = max(last.get(key, -1), r.doc_id)
    assert ids(stages[2]) == set(last.values())


def test_one_of_near_copies_stays(stages):
    found = jaccard.jaccard_components(stages[2], pipeline.NEAR)
    assert ids(stages[3]) == {r.component_id for r in found.collect()}


def test_mix_repeats_rows(stages):
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(stages[3]).collect()}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, (t, s) in taken.items() if s and (n := (2 * t + s) // (2 * s))}


def test_last_stage(spark, stages):
    rows = pipeline.STAGES[-1][1](spark, stages[4], SF)
    assert rows.count() == stages[4].count()
    assert rows.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_foreign_text_is_rejected(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    made = []
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"):
        for n in (20, 200, 1000):
            made += [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n)) for _ in range(5)]
    words = [w for r in docs.filter("lang IS NOT NULL").orderBy("doc_id").limit(20).collect() for w in (r.text or "").split()[:5] if w.isalpha()]
    clean = [" ".join(words[k : k + 4]) for k in range(0, len(words) - 4, 4)]
    more = [(-1 - k, t, None) for k, t in enumerate(made)] + [(-1000 - k, t, None) for k, t in enumerate(clean)]
    all_docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = ids(pipeline.identify_language(spark, all_docs, SF))
    assert {i for i in got if i < 0} == {i for i, _, _ in more if i <= -1000}
    assert {i for i in got if i >= 0} == ids(docs.filter(F.col("text").rlike(r"\pL")))


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _drop_ string, size int, score int"
    rows = [(1, None, "en", "a", 0, "x", 1, 1), (None, "the words of the text", "en", None, 0, "x", 1, 1), (2, "the words of that", "en", "a", 0, "x", 1, 1), (2, "the words of that", "en", "a", 0, "x", 1, 1), (3, "THE words of that", None, "b", 0, "x", 1, 1), (4, "", None, None, None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, f in pipeline.STAGES[:-1]:
            docs = f(spark, docs, SF)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
        assert ids(docs) <= {3, None}


def test_marks_and_digits_are_no_letters(spark):
    rows = [(k, "plain words of one language again", "en") for k in range(8)] + [(90, "́̂ 12 ̃", None), (91, "á", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_text_", F.lit("other"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.train(docs).predict(docs).collect()}
    assert found[90] == ("und", 0.0) and found[91][0] == "en" and found[0] == ("en", 1.0)
