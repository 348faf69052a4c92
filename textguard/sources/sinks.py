"""Sinks of results: JSON, CSV and text rows, exit codes, metrics, and settings read from YAML-like files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SETTINGS = 10 << 20
FIELDS = ("label", "risk", "rejected", "hits")


def exit_code(label: Column) -> Column:
    """blocked 2, malicious 1, everything else 0."""
    low = F.lower(label)
    return F.when(low == "blocked", 2).when(low == "malicious", 1).otherwise(0)


def worst(results: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: the largest exit code, 0 for an empty table."""
    return results.agg(F.coalesce(F.max(exit_code(F.col(label_col))), F.lit(0)).alias("exit_code"))


def as_json(results: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, nulls kept."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def csv_line(results: DataFrame) -> Column:
    """The four fields of a row as a line of CSV; arrays are joined by semicolons, a missing field is empty."""
    have = {f.name: f.dataType.simpleString() for f in results.schema}
    columns = [(F.array_join(c, ";") if have.get(c, "").startswith("array") else F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in FIELDS]
    return F.to_csv(F.struct(*columns))


def text_line() -> Column:
    """A row's label, risk and hits for people."""
    return F.concat(F.upper("label"), F.format_string(" (risk %.3f)", F.col("risk").cast("double")), F.when(F.size("hits") > 0, F.concat(F.lit(": "), F.array_join("hits", ", "))).otherwise(""))


def as_csv(results: DataFrame) -> DataFrame:
    return results.select(csv_line(results).alias("value"))


def as_text(results: DataFrame) -> DataFrame:
    return results.select(text_line().alias("value"))


def write_metrics(samples: DataFrame, summary: DataFrame, path: str) -> None:
    """Each sample as a JSON line under path/samples, and the summary's one row under path/summary."""
    samples.write.mode("overwrite").json(f"{path}/samples")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def markdown(summary: DataFrame) -> str:
    """A summary's few rows as a table."""
    rows = summary.collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(summary.columns), line("-" for _ in summary.columns), *(line(r) for r in rows)])


def settings(path: str) -> dict:
    """Settings of a JSON file, or of `key: value` lines with # comments and no nesting; a file of more than MAX_SETTINGS bytes and
    a line that isn't one are errors, and nothing in it is ever executed."""
    file = Path(path)
    if file.stat().st_size > MAX_SETTINGS:
        raise ValueError("the settings are too large")
    text = file.read_text("utf-8")
    if text.lstrip()[:1] in ("{", "["):
        return json.loads(text)
    out: dict = {}
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0].strip()
        if not bare or bare.startswith("#") or bare == "---":
            continue
        key, colon, value = bare.partition(":")
        if not colon or key != key.strip() or line[:1].isspace():
            raise ValueError(f"line {n} is no setting")
        value = value.strip()
        try:
            out[key] = json.loads(value) if value else None
        except json.JSONDecodeError:
            out[key] = value.strip("'\"")
    return out
