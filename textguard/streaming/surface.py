"""What a user plugs in: functions for SQL, and a registry of probes, disguises and classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textguard.operators import decode as D
from textguard.operators import rules as R

_KINDS = ("probe", "mutation", "classifier", "judge")
_REGISTRY: dict[tuple[str, str], Callable] = {}


def plug(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Registers a function: a probe (spark -> table), a mutation or classifier (column -> column), a judge (table -> table)."""
    if kind not in _KINDS:
        raise ValueError(f"a plug is one of {', '.join(_KINDS)}")

    def add(f: Callable) -> Callable:
        _REGISTRY[kind, name] = f
        return f

    return add


def plugged(kind: str) -> dict[str, Callable]:
    return {n: f for (k, n), f in _REGISTRY.items() if k == kind}


def classify(df: DataFrame, text_col: str, names: list[str] | None = None) -> DataFrame:
    """Adds a column for every registered classifier."""
    found = {n: f for n, f in plugged("classifier").items() if names is None or n in names}
    return df.withColumns({n: f(F.col(text_col)) for n, f in found.items()}) if found else df


def _rules(texts: pa.Array) -> pa.Array:
    names = tuple(r.name for r in R.active())
    return pa.array([R.find_hits(t.lower(), names) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))


@F.udtf(returnType="enc string, text string")
class Views:
    """The decoded views of a text as rows."""

    def eval(self, text: str):
        for enc, view in D.tree_of(text) if text else []:
            yield enc, view


def install(spark: SparkSession) -> None:
    """Makes rule_hits(text) and the table function decoded_views(text) known to SQL."""
    spark.udf.register("rule_hits", F.arrow_udf(_rules, Ty.ArrayType(Ty.StringType())))
    spark.udtf.register("decoded_views", Views)


def once(make: Callable[[], object]) -> Callable[[], object]:
    """A value that each worker process makes on first use and keeps, such as a tokenizer."""
    held: list[object] = []

    def get() -> object:
        if not held:
            held.append(make())
        return held[0]

    return get


def too_large(c: Column, most: int = 50_000) -> Column:
    """Texts that a step with a time limit wouldn't finish: Spark stops no expression, so their size is bounded before."""
    return F.length(c) > most
