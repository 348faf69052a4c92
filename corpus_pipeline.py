"""A training corpus from documents: toxic documents go, repeated lines go, one of each group of near-duplicates and no
benchmark passage stays, and what is left is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textguard.llm import bpe, decontam, lines, neardup, toxicity
from textguard.llm.common import new_path, scratch
from textguard.llm.queries import table
from textguard.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is toxic go; null, empty and repeated rows stay; an empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first in order of (doc_id, text hash, line) stays. A text that loses every line goes; null,
    empty and blank ones stay; rows that repeat an id and text are one document."""
    ship(spark)
    return lines.dedup_lines(docs, count_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group the smallest (doc_id, text hash) stays; texts without words stay; of repeated rows one stays."""
    ship(spark)
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has a benchmark passage go; null, empty and repeated rows stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, same): one row for each row of `docs`; a null text counts as an empty one."""
    ship(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte-pair encoding", tokenize),
]

#: SQL can express neither the learned score, nor MinHash candidates, nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written as Parquet and read again as the next one's input."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):  # what the stage's operator wrote goes when its result stands
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
