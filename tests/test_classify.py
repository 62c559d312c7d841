"""The trained classifier: learns what separates, weighs rare labels, reads back from disk, and stands nulls and empty texts."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lodestone.operators import classify

WORDS = ["river", "stone", "bridge", "walk", "north", "garden", "paper", "light"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    text = lambda bad: " ".join(rng.choice(WORDS) + (rng.choice(["###", "$$$"]) if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(5, 40)))
    data = [(i, text(i % 10 == 0), int(i % 10 != 0), "x") for i in range(400)] + [(900, None, None, "x"), (901, "", 1, "x"), (902, "a b", None, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, label int, terms string")


def test_classifier(spark, rows, tmp_path):
    rows = rows.drop("terms")
    test = classify.held_out(F.col("doc_id"))
    model = classify.fit(rows.where(~test), "text", "label")
    model.write().save(str(tmp_path / "m"))
    read = PipelineModel.load(str(tmp_path / "m"))
    scored = classify.probability(rows, read, "text")
    assert scored.columns == ["doc_id", "text", "label", "probability"] and scored.count() == 403
    r = classify.accuracy(scored.where(test & F.col("label").isNotNull()), "label").first()
    assert r.accuracy > 0.97 and 0.8 < r.majority < 0.97
    assert {str(x.probability) for x in scored.collect()} == {str(x.probability) for x in classify.probability(rows, model, "text").collect()}


def test_terms(spark):
    got = spark.createDataFrame([("Stop!! THE a1, ...",), (None,)], "t string").select(classify.terms(F.col("t")).alias("x")).collect()
    assert got[0].x[:7] == ["stop", "the", "a1", "shape word !!", "shape CAPS ", "shape NUMBER ,", "shape signs .."]
    assert [x.split()[0] for x in got[1].x] == ["share"] * 5 + ["length"]


def test_words_are_made_once_and_texts_read_once(spark):
    """A text is split in words and in lines once for all its terms, and training makes its rows' terms once."""
    rows = spark.createDataFrame([(i, f"word{i % 3} SIGN {i}", i % 2) for i in range(40)], "doc_id long, text string, label int").repartition(2)
    plan = rows.select(classify.terms(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    classify.fit(rows.withColumn("text", F.udf(read, "string")("text")), "text", "label")
    # Words and lines are two uses of a text.
    assert seen.value <= 80
