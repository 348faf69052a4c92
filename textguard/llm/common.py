"""Shared folder, written tables and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textguard-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of the tables that `written` made, in order.
_MADE: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """The rows of `df`, written to the shared folder and read again, which cuts the lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # the one use of the JVM gateway: a classic session is needed
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that `written` made and that nothing needs any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators wrote inside; what is to last must be written elsewhere before."""
    began = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[began:]:
            _delete(spark, path)
        del _MADE[began:]


def node(id_col: str, text_col: str) -> F.Column:
    """A document's number: its id; for an id that isn't a whole number a negative one made of the id, for a null id
    one made of the text."""

    def negative(of: F.Column) -> F.Column:
        return -(F.abs(F.shiftright(F.xxhash64(of), 2))) - 2

    own = F.col(id_col)
    return F.coalesce(own.try_cast("long"), F.when(own.isNotNull(), negative(own.cast("string"))), negative(F.coalesce(F.col(text_col), F.lit(""))))


#: Type of a document's key.
KEY = "struct<id:bigint,own:bigint>"


def key(id_col: str, text_col: str) -> F.Column:
    """A document's key: its number and the hash of its text, so that rows of one id and several texts are several
    documents and rows that repeat both are one."""
    return F.struct(node(id_col, text_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b): comp is the smallest node of its connected component.

    Alternating large-star and small-star steps; each is written, and the loop ends when a round changes nothing.
    The smallest neighbour comes of a partial aggregation and goes back by a join, so a hub of very many neighbours is
    no task of its own. Nodes may be of any type with an order. An empty table of edges gives an empty one.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    cur = written(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(mark) == seen or not mark[0]:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        seen = tuple(mark)
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "edges")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = written(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(large)
        drop(cur)
        cur = nxt


def fields(df: DataFrame, extra: str) -> T.StructType:
    """The schema of `df` with the fields of a DDL string after it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(extra).fields])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
