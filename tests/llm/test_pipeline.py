"""The pipeline's stages on a small table with planted rows."""

import random
import tracemalloc

import pytest

import corpus_pipeline as pipeline
from braidline.llm import language

WORDS = [f"{a}{b}" for a in "word term noun verb line page book song".split() for b in "aeiouy"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(80))
    rows = [(i, text()) for i in range(120)]
    rows += [(200 + i, f"vilething {text()} vilething") for i in range(60)]
    rows += [(300, rows[5][1].replace(" ", "  ")), (301, rows[6][1] + " tail"), (302, "123 456"), (303, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, int(k >= 200)) for k, _ in rows[:170]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialise(stage(spark, docs, folder), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["toxicity"] == set(range(120)) | {300, 301, 302, 303}
    assert kept["language"] == set(range(120)) | {300, 301}
    assert kept["exact_dedup"] == set(range(120)) | {301}
    assert kept["near_dedup"] == set(range(120))
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(range(120))


def test_run(spark, folder):
    assert pipeline.run(spark, folder).select("doc_id").distinct().count() == 120


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def texts(seed, n=80):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_rows_decide(spark, folder):
    """Repeated and null ids, equal rows, clashing columns and long texts."""
    a, b, c, long = texts(1), texts(2), texts(3), texts(4, 30_000)
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (None, a), (None, texts(5)), (None, texts(5)), (11, None), (12, ""), (13, long), (14, long + " tail")]
    schema = "doc_id long, text string, lang string, _found string, _row int, _ROW_ int, component_id long, keep_id long, kept boolean, n long"
    docs = spark.createDataFrame([(k, t, "en", "f", 1, 2, 3, 4, False, i) for i, (k, t) in enumerate(rows)], schema)
    left = pipeline.drop_copies(spark, docs, folder)
    assert left.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in left.collect())
    assert got == sorted([(3, a), (7, b), (9, c), (-1, texts(5)), (11, ""), (13, long), (14, long + " tail")])
    near = pipeline.drop_near_copies(spark, left, folder)
    assert near.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in near.collect())
    assert got == sorted([(3, a), (7, b), (9, c), (-1, texts(5)), (11, ""), (13, long)])
    found = pipeline.drop_unknown_language(spark, near, folder)
    assert found.columns == docs.columns and found.schema["_found"].dataType.simpleString() == "string"
    assert {r._found for r in found.collect()} == {"f"} and found.where("text IS NULL").count() == 0
    assert pipeline.drop_toxic(spark, docs, folder).columns == docs.columns
    packed = pipeline.pack(spark, near, folder)
    assert {r.doc_id for r in packed.collect()} == {3, 7, 9, None, 11, 13}


def test_near_copies_under_one_id(spark, folder):
    """Rows that share an id are documents of their own; the smallest id of a group stays."""
    a, b = texts(21), texts(22)
    rows = [(5, a), (5, b), (2, a + " x"), (None, b + " x"), (8, a + " y")]
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    got = sorted(map(tuple, pipeline.drop_near_copies(spark, docs, folder).collect()))
    assert got == sorted([(2, a + " x"), (5, b)])


@pytest.mark.parametrize("stage", [pipeline.drop_copies, pipeline.drop_near_copies])
def test_texts_that_stay_are_not_exchanged(spark, folder, stage):
    """Only rows in the slots of those that go meet them by an exchange, whatever their number."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    a = texts(31)
    rows = [(i, a) for i in range(3)] + [(i, texts(40 + i)) for i in range(3, 9)] + [(9, a + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = stage(spark, docs, folder)
        plan = left._jdf.queryExecution().sparkPlan().toString()
        got = sorted(r.doc_id for r in left.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == [0, *range(3, 9), *([9] if stage is pipeline.drop_copies else [])]
    assert any("BroadcastHashJoin" in x and "LeftAnti" in x for x in plan.splitlines())


def test_undrawn_words_take_no_memory():
    """Of the language rows the driver keeps the text, not an object a word."""

    def peak(rows):
        samples = [(lang, [" ".join(WORDS[:32])] * 16) for lang in ("en", "fr") for _ in range(rows)]
        tracemalloc.start()
        try:
            language.fit(samples, sequences=4, epochs=0)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(1)
    assert peak(150) - peak(1) < 500_000
