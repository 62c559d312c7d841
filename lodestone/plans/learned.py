"""Classifiers trained on the labelled documents, measured on those held out and applied to all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify
from .relational import table

QUERIES, ORACLES = {}, {}
LABELS = ("quality", "toxic")


def _labelled(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", *LABELS), "doc_id")
    return rows.withColumn("test", classify.held_out(F.col("doc_id")))


def noise_classifier(spark, sf):
    """label, n_train, n_test, accuracy, majority: a model for each label, trained on seven tenths of the labelled documents and measured on the rest."""
    rows, out = _labelled(spark, sf), None
    for label in LABELS:
        model = classify.fit(rows.where("not test"), "text", label)
        found = classify.accuracy(classify.probability(rows.where("test"), model, "text"), label)
        n = rows.where("not test").agg(F.count("*")).scalar()
        one = found.select(F.lit(label).alias("label"), n.alias("n_train"), F.col("n").alias("n_test"), F.round("accuracy", 6).alias("accuracy"), F.round("majority", 6).alias("majority"))
        out = one if out is None else out.unionByName(one)
    return out


def classifier_holds(spark, sf):
    """The same, with whether each model is right on four in five of the rows held out, which it is down to sixty rows of training."""
    return noise_classifier(spark, sf).select("label", "n_train", "n_test", (F.col("accuracy") >= 0.8).alias("reached"))


def noise_decisions(spark, sf):
    """doc_id, noise, decision: every document by the model of quality; what it gives less than a half goes."""
    model = classify.fit(_labelled(spark, sf), "text", "quality")
    rows = classify.probability(table(spark, sf, "documents").select("doc_id", "text"), model, "text")
    return rows.select("doc_id", F.round(1 - F.col("probability"), 6).alias("noise"), F.when(F.col("probability") >= 0.5, "KEEP").otherwise("DISCARD").alias("decision"))


QUERIES |= {f.__name__: f for f in (noise_classifier, classifier_holds, noise_decisions)}
_TEST = "('0x' || substring(md5(doc_id::VARCHAR), 1, 4))::INT % 10 < 3"
ORACLES |= {
    "classifier_holds": f"SELECT label, count(*) FILTER (WHERE NOT test) AS n_train, count(*) FILTER (WHERE test) AS n_test, true AS reached FROM (SELECT doc_id, {_TEST} AS test FROM documents JOIN labels USING (doc_id)), (VALUES ('quality'), ('toxic')) v(label) GROUP BY label",
}
