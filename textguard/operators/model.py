"""Trained models: TF-IDF with a balanced logistic regression, calibrated by folds, and classifiers of vectors.

The models are Spark ML's; they are fitted on the labelled rows, however many. Folds and splits go by a hash of the id,
so that they are the same on every run and machine.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS, FOLDS = 5000, 5


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters or digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


_TOKEN = re.compile(r"\w{2,}")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of each Arrow batch, so that a row a batch and not a row an occurrence goes on."""
    for batch in batches:
        tf, df = Counter(), Counter()
        for t in batch.column(0).to_pylist():
            own = Counter(_TOKEN.findall(t))
            tf.update(own)
            df.update(own.keys())
        yield pa.RecordBatch.from_arrays([pa.array(tf.keys(), pa.string()), pa.array(tf.values(), pa.int64()), pa.array([df[k] for k in tf], pa.int64())], names=["term", "tf", "df"])


def idf(df: DataFrame, text_col: str = "text", terms: int = TERMS) -> DataFrame:
    """(term, tf, df, idf) of the `terms` most frequent terms: idf = ln((1 + n) / (1 + df)) + 1. The number of terms is
    the vocabulary's size, a parameter of the model."""
    n = df.count()
    counted = df.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t_")).mapInArrow(_counts, "term string, tf long, df long")
    per = counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return per.orderBy(F.desc("tf"), "term").limit(terms).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)


def fold(id_col: str, k: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(k)).cast("int")


def weighted(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds `weight`: rows / (classes * rows of the class), so that classes count alike."""
    n = df.groupBy(label_col).agg(F.count("*").alias("n_"))
    total = n.agg(F.sum("n_").alias("all_"), F.count("*").alias("k_"))
    classes = n.join(F.broadcast(total), F.lit(True)).select(label_col, (F.col("all_") / (F.col("k_") * F.col("n_"))).alias("weight"))  # a row for each class
    return df.join(F.broadcast(classes), label_col)


class Vocabulary:
    """TF-IDF vectors over the most frequent terms, of length 1."""

    def __init__(self, docs: DataFrame, text_col: str = "text", terms: int = TERMS):
        table = idf(docs, text_col, terms).select("term", "idf").collect()  # `terms` rows at most
        self.text_col, self.idf = text_col, [r["idf"] for r in table]
        self.counts = CountVectorizerModel.from_vocabulary([r["term"] for r in table], "words_", "counts_") if table else None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `features`. A null text has no words and gets zeros."""
        d = df.withColumn("words_", tokens(F.coalesce(F.col(self.text_col), F.lit(""))))
        if not self.counts:
            return d.withColumn("features", array_to_vector(F.array(F.lit(0.0)))).drop("words_")

        d = self.counts.transform(d)
        d = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="counts_", outputCol="tfidf_").transform(d)
        return Normalizer(inputCol="tfidf_", outputCol="features").transform(d).drop("words_", "counts_", "tfidf_")


@dataclass
class Calibrated:
    """The mean of several models, each with the isotonic curve that rows it hadn't seen gave."""

    parts: list[tuple]

    def transform(self, df: DataFrame, p_col: str = "p") -> DataFrame:
        """Adds the probability of the positive class."""
        out, names = df, []
        for i, (model, curve) in enumerate(self.parts):
            model = model.copy().setProbabilityCol("prob_").setRawPredictionCol("raw_").setPredictionCol("pred_")
            out = model.transform(out).withColumn("m_", vector_to_array("prob_")[1])
            curve = curve.copy().setFeaturesCol("m_").setPredictionCol(f"q{i}_")
            out = curve.transform(out).drop("prob_", "raw_", "pred_", "m_")
            names.append(f"q{i}_")
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return out.withColumn(p_col, mean).drop(*names)


def fit_calibrated(df: DataFrame, id_col: str, label_col: str = "label", folds: int = FOLDS, regularisation: float = 0.001) -> Calibrated:
    """Of each fold a balanced logistic regression on the others and an isotonic curve on the fold; folds that lack a
    class are left out. Rows need `features`; rows with a null label don't count."""
    rows = df.where(F.col(label_col).isNotNull()).withColumn("fold_", fold(id_col, folds)).withColumn(label_col, F.col(label_col).cast("double")).persist()
    parts = []
    try:
        for k in range(folds):
            train, held = rows.where(F.col("fold_") != k), rows.where(F.col("fold_") == k)
            if train.select(label_col).distinct().count() < 2 or held.isEmpty():
                continue
            model = LogisticRegression(labelCol=label_col, weightCol="weight", regParam=regularisation, standardization=False, maxIter=50).fit(weighted(train, label_col))
            scored = model.transform(held).withColumn("m_", vector_to_array("probability")[1]).select("m_", label_col)
            parts.append((model, IsotonicRegression(featuresCol="m_", labelCol=label_col).fit(scored)))
    finally:
        rows.unpersist()
    if not parts:
        raise ValueError("labels of both classes are needed")
    return Calibrated(parts)


def split(df: DataFrame, id_col: str, label_col: str, share: int = 5) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows: of every label about one in `share` is held out, by a hash of the id and the label."""
    at = F.pmod(F.xxhash64(F.col(id_col), F.col(label_col), F.lit("split")), F.lit(share))
    return df.where(at != 0), df.where(at == 0)


def vectors(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    """Adds `features` from an array of numbers."""
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def fit_vectors(df: DataFrame, label_col: str = "label", hidden: tuple[int, ...] = (), seed: int = 7):
    """A classifier of `features`: logistic regression, or with `hidden` a perceptron of these layers."""
    rows = df.withColumn(label_col, F.col(label_col).cast("double"))
    if not hidden:
        return LogisticRegression(labelCol=label_col, weightCol="weight", regParam=0.001, maxIter=50).fit(weighted(rows, label_col))
    width = rows.select(F.size(vector_to_array("features"))).first()[0]
    classes = int(rows.agg(F.max(label_col)).first()[0]) + 1
    return MultilayerPerceptronClassifier(labelCol=label_col, layers=[width, *hidden, classes], seed=seed, maxIter=60).fit(rows)


def save(model, path: str) -> None:
    """A Spark ML model with a manifest of its files' SHA-256 beside it."""
    model.write().overwrite().save(path)
    manifest(SparkSession.active(), path).coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest) of all files below a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", ".*" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "").alias("file"), F.sha2("content", 256).alias("digest"))


def load(spark: SparkSession, kind, path: str):
    """The saved model, if its files are those of the manifest; ValueError otherwise."""
    known = spark.read.json(path.rstrip("/") + ".manifest")
    if not manifest(spark, path).select("file", "digest").exceptAll(known.select("file", "digest")).isEmpty() or not known.select("file", "digest").exceptAll(manifest(spark, path).select("file", "digest")).isEmpty():
        raise ValueError("the model's files don't match their manifest")
    return kind.load(path)
