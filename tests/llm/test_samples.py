from tidemark.llm import common, langid, toxicity
from tidemark.llm.samples import sample_texts

EN, FR = "the quick brown fox jumps over the lazy dog and runs ", "le renard brun saute par dessus le chien paresseux et court "
SCHEMA = "doc_id long, text string, lang string"


def test_languages_of_long_documents_are_learned(spark):
    rows = [(i, EN * 5, "en") for i in range(40)] + [(100 + i, FR * 700, "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    assert model.langs == ["en", "fr"]
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model).collect())


def test_texts_that_cannot_be_used_take_no_place(spark):
    rows = [(i, None if i % 2 else "", "fr") for i in range(500)] + [(500 + i, f"texte {i}", "fr") for i in range(30)] + [(2000, "y" * 100, "fr"), (2000, "short", "fr"), (None, "x", "fr")]
    docs = spark.createDataFrame(rows, SCHEMA)
    named = docs.where("doc_id is not null").groupBy("doc_id").agg({"lang": "min"}).toDF("id", "label")
    got = sample_texts(docs, named, 31, 50, "doc_id", "text")
    assert sorted(t for _, t in got) == sorted(["short", *(f"texte {i}" for i in range(30))])
    assert len(sample_texts(docs, named, 7, 50, "doc_id", "text")) == 7
    assert [t for _, t in sample_texts(docs.where("text like 'yy%'"), named, 7, 50, "doc_id", "text")] == ["y" * 50]


def test_toxic_documents_of_any_length_train(spark):
    words = ["plain", "words", "about", "weather", "and", "gardens"]
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(40)) + f" n{i}. ", 0) for i in range(300)]
    rows += [(1000 + i, (" ".join(words[(i * k) % 6] for k in range(40)) + f" m{i}. filthy vermin scum. ") * 400, 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), per_label=100)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model, real=False).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_settings_of_the_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, EN, "en")], SCHEMA)
    try:
        for given, then in (("64m", str(common.ARROW_BYTES)), ("1g", str(common.ARROW_BYTES)), ("2m", "2m"), ("4096b", "4096b"), ("1048576", "1048576")):
            spark.conf.set(name, given)
            assert langid.predict(docs, langid.train(docs)).count() == 1
            assert spark.conf.get(name) == given  # operators leave the session alone
            common.small_batches(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
