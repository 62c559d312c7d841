"""A trained text classifier: hashed words and word shapes, logistic regression fitted by tree aggregation of gradients.

Training reads its rows where they lie: each round sums gradients over the
partitions and up a tree, and the driver holds the weights (2 ** 14 by
default), never rows. A fitted model is a Spark ML pipeline, so it is stored,
read and applied as any other, as a projection that adds a probability.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import kept


def terms(text: Column) -> Column:
    """Words without their punctuation, in lower case, the shape of each (all capitals, its last signs, digits), and how much of the text these are, in tenths. A null text counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    # Bound as a lambda's argument, words and lines are made once; named again in place of it, they would be made anew for each use.
    return F.element_at(F.transform(F.array(F.struct(words.alias("words"), lines.alias("lines"))), lambda x: _terms(x["words"], x["lines"])), 1)


def _terms(words: Column, lines: Column) -> Column:
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    case = lambda w: F.when(w.rlike(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$"), "CAPS").when(w.rlike(r"\p{N}"), "NUMBER").when(w.rlike(r"\p{L}"), "word").otherwise("signs")
    shape = F.transform(words, lambda w: F.concat(F.lit("shape "), case(w), F.lit(" "), F.regexp_extract(w, r"([^\p{L}\p{N}]{0,2})$", 1)))
    tenths = lambda name, n, of: F.concat(F.lit(f"share {name} "), F.coalesce(F.round(10 * n / F.nullif(of, F.lit(0))), F.lit(0.0)).cast("int").cast("string"))
    hit = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern)))
    shares = [
        tenths("caps", hit(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$"), F.size(words)),
        tenths("signs", hit(r"[^\p{L}\p{N}.,;:'\"()-]"), F.size(words)),
        tenths("numbers", hit(r"\p{N}"), F.size(words)),
        tenths("repeats", F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        tenths("words", F.size(F.array_distinct(words)), F.size(words)),
        F.concat(F.lit("length "), F.floor(F.log2(F.size(words) + F.lit(1.0))).cast("string")),
    ]
    return F.concat(F.filter(bare, lambda w: w != ""), shape, F.array(*shares))


def fit(rows: DataFrame, text: str, label: str, size: int = 1 << 14, strength: float = 0.003, sparse: float = 0.5, rounds: int = 50) -> PipelineModel:
    """A model of rows with a text and a label of 0 or 1. Both labels weigh the same in all, however rare one is; rows without a label are left out."""
    held = rows.select(terms(F.col(text)).alias("terms"), F.col(label).cast("double").alias("label")).where("label is not null")
    share = held.agg(F.avg("label")).scalar()
    held = held.withColumn("weight", F.when(F.col("label") > 0, 0.5 / share).otherwise(0.5 / (1 - share)))
    hashed = HashingTF(inputCol="terms", outputCol="features", numFeatures=size, binary=True)
    learner = LogisticRegression(weightCol="weight", regParam=strength, elasticNetParam=sparse, maxIter=rounds)
    # Training passes over its rows more than once; their hashed words are made in the first.
    with kept(hashed.transform(held).select("features", "label", "weight")) as features:
        return PipelineModel(stages=[hashed, learner.fit(features)])


def probability(rows: DataFrame, model: PipelineModel, text: str, name: str = "probability") -> DataFrame:
    """The rows with the probability of label 1."""
    out = model.transform(rows.withColumn("terms", terms(F.col(text))))
    return out.withColumn(name, F.element_at(vector_to_array("probability"), 2)).select(*rows.columns, name)


def held_out(key: Column, tenths: int = 3) -> Column:
    """Whether a row is kept from training: by a hash of its key, the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 10 < tenths


def accuracy(scored: DataFrame, label: str, name: str = "probability") -> DataFrame:
    """(n, accuracy, majority): of rows with label and probability; majority is what the more frequent label alone would reach."""
    right = (F.col(name) >= 0.5) == (F.col(label) == 1)
    one = F.avg(F.col(label).cast("double"))
    return scored.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.greatest(one, 1 - one).alias("majority"))
