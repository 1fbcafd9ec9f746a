"""Long labelled texts teach their language; where nothing is learned, the stage keeps its input."""

from stratalog.llm import language

LONG = {"en": "the dog and the cat are in the house ", "de": "der hund und die katze sind im haus "}


def test_long_texts_teach(spark):
    rows = [(i, "1 2 3 " * 2000 + LONG[k] * 300, k) for i in range(8) for k in ("en",)] + [(100 + i, LONG["de"], "de") for i in range(8)]
    model = language.learned_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(model) == ["de", "en"] and all(len(d) <= language.DICTIONARY_BYTES for d in model.values())
    judged = language.identified(spark.createDataFrame([(1, "the cat is in the house and the dog is in the house too, the house of the dog and the cat")], "doc_id long, text string"), model, keep=[])
    assert [r["lang_pred"] for r in judged.collect()] == ["en"]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert language.language_stage(spark, docs, "").count() == 2
