"""Texts of a language that wasn't learned, and gibberish, are rejected; texts of learned languages stay."""

import random
import string

from pyspark.sql import functions as F

from stratalog.llm import language


def test_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    fold = language.remainder_of_id("doc_id", 3)
    model = language.learned_dictionaries(docs.where((fold != 1) & (F.col("lang") != "de")))

    def share_rejected(rows):
        return language.identified(rows, model, keep=[]).agg(F.avg(F.col("rejected").cast("int"))).first()[0]

    assert share_rejected(docs.where((fold == 1) & (F.col("lang") != "de"))) < 0.05
    assert share_rejected(docs.where("lang = 'de'")) > 0.9
    rng = random.Random(5)
    noise = [(i, "".join(rng.choices(string.ascii_lowercase + "  ", k=rng.choice((100, 300, 2000))))) for i in range(200)]
    assert share_rejected(spark.createDataFrame(noise, "doc_id long, text string")) > 0.9
