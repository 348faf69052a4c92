"""Unicode normalisation, which Spark has no built-in function for: one Arrow function for the batch."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = 0.25


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("changed", T.BooleanType()))
def _nfkc(s: pd.Series) -> pd.DataFrame:
    texts, changed = [], []
    for t in s:
        new = unicodedata.normalize("NFKC", t)
        texts.append(new)
        changed.append(new != t and sum(unicodedata.normalize("NFKC", c) != c for c in t) > CHANGE * len(t))
    return pd.DataFrame({"text": texts, "changed": changed})


def unmarked(t: str) -> str:
    """A text without combining marks, composed."""
    if t.isascii():
        return t
    parts = unicodedata.normalize("NFD", t)
    for mark in [c for c in set(parts) if unicodedata.category(c) == "Mn"]:
        parts = parts.replace(mark, "")
    return unicodedata.normalize("NFC", parts)


def _unmarked(texts: pa.Array) -> pa.Array:
    return pa.array([t and unmarked(t) for t in texts.to_pylist()], pa.string())


def _ascii(c):
    return c.rlike(r"^[\x00-\x7F]*\z")


def nfkc(df: DataFrame, text_col: str = "text") -> DataFrame:
    """NFKC in place, and nfkc_changed: more than a quarter of the characters had a compatibility form. ASCII texts
    skip the function; null stays null."""
    c = F.col(text_col)
    made = df.withColumn("made_", _nfkc(F.when(~_ascii(F.coalesce(c, F.lit(""))), c).otherwise("")))
    skip = c.isNull() | _ascii(F.coalesce(c, F.lit("")))
    flagged = made.withColumn("nfkc_changed", F.coalesce(F.col("made_.changed") & ~skip, F.lit(False)))  # before the text is replaced
    return flagged.withColumn(text_col, F.when(skip, c).otherwise(F.col("made_.text"))).drop("made_")


def no_marks(c: Column) -> Column:
    """The text without combining marks; ASCII texts aren't sent to Python."""
    plain = _ascii(F.coalesce(c, F.lit("")))
    return F.when(plain, c).otherwise(F.arrow_udf(_unmarked, T.StringType())(F.when(plain, "").otherwise(c)))


def strip_marks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Combining marks go in place; null stays null."""
    return df.withColumn(text_col, no_marks(F.col(text_col)))
