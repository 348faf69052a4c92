"""Trained models over labelled documents and vectors; their figures on rows that they haven't seen."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textguard.operators import evals as E
from textguard.operators import model as M
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_prep import labelled

TERMS = 500


@query("m_idf", f"""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents), c as (select term, count(*) as tf, count(distinct doc_id) as df from w group by term)
select term, tf::bigint as tf, df::bigint as df, round(ln((1.0::double + (select count(*) from documents)) / (1.0::double + df)) + 1, 6) as idf from c order by tf desc, term limit {TERMS}""")  # fmt: skip
def m_idf(spark, sf_dir):
    """The vocabulary's size is the limit; it is the model's parameter."""
    return M.idf(planted.table(spark, sf_dir, "documents"), terms=TERMS).withColumn("idf", F.round("idf", 6))


@query("m_weights", """with l as (select doc_id, max(toxic) as label from labels where toxic is not null group by doc_id), d as (select label from documents join l using (doc_id))
select label::int as label, round((select count(*) from d) / ((select count(distinct label) from d) * count(*))::double, 6) as weight from d group by label""")  # fmt: skip
def m_weights(spark, sf_dir):
    return M.weighted(labelled(spark, sf_dir)).groupBy("label").agg(F.round(F.max("weight"), 6).alias("weight"))


@query("m_model")
def m_model(spark, sf_dir):
    """Confusion of the calibrated model on held-out labelled documents."""
    docs = planted.table(spark, sf_dir, "documents")
    train, held = M.split(labelled(spark, sf_dir), "doc_id", "label")
    vocabulary = M.Vocabulary(docs, terms=2000)
    model = M.fit_calibrated(vocabulary.transform(train), "doc_id")
    return E.confusion(model.transform(vocabulary.transform(held)), F.col("label") == 1, F.col("p") >= 0.5)


@query("m_embedding")
def m_embedding(spark, sf_dir):
    """Share of held-out vectors whose label the classifier gives."""
    train, held = M.split(M.vectors(planted.table(spark, sf_dir, "embeddings")), "vec_id", "label")
    scored = M.fit_vectors(train).transform(held)
    return scored.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query("m_perceptron")
def m_perceptron(spark, sf_dir):
    train, held = M.split(M.vectors(planted.table(spark, sf_dir, "embeddings")), "vec_id", "label")
    scored = M.fit_vectors(train, hidden=(32,)).transform(held)
    return scored.select("vec_id", F.col("prediction").cast("long").alias("label"), F.round(F.array_max(vector_to_array("probability")), 4).alias("p"))
