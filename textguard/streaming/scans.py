"""Texts and verdicts as streams: the scan of a stream, windows over events, and the store's feedback loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.operators import store as S
from textguard.operators import vote as V


def lines(spark: SparkSession, path: str, schema: str = "id long, text string, ts timestamp") -> DataFrame:
    """JSON lines of a folder as a stream; a line that can't be read has nulls and is scanned as an empty text."""
    return spark.readStream.schema(schema).json(path)


def scanned(stream: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The scan has no state, so a stream is scanned by the same plan as a table."""
    return V.scan(stream, text_col, **settings)


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(start, by…, n) per window; `late` is how long a stream waits for late rows."""
    d = events.withWatermark(at, late) if late else events
    return d.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sliding(events: DataFrame, at: str, width: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    """(start, by…, n) per window of `width`, one every `step`."""
    d = events.withWatermark(at, late) if late else events
    return d.groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """(by…, start, n): runs of a key's rows with no gap of `gap` or more between two."""
    d = events.withWatermark(at, late) if late else events
    return d.groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), "n")


def feedback(stream: DataFrame, read_store: Callable[[], DataFrame], write_store: Callable[[DataFrame], None], sink: Callable[[DataFrame, int], None], checkpoint: str, text_col: str = "text", now: Column | None = None) -> StreamingQuery:
    """Each micro-batch is looked up in the store as it stood before, scanned, handed to `sink` with `known`, and its
    malicious texts are registered. Texts of one batch don't see each other; a batch that is run again adds nothing
    twice, as the store holds a text once."""

    def batch(rows: DataFrame, number: int) -> None:
        store = read_store()
        rows = rows.persist()
        try:
            scanned_ = V.scan(rows, text_col).withColumnRenamed("flags", "evasion")
            marked = S.check(S.fingerprints(scanned_, text_col), store).withColumnRenamed("flags", "known")
            sink(marked, number)
            bad = marked.where("label = 'malicious' and size(hits) > 0").select(text_col)
            write_store(S.register(store, bad, now if now is not None else F.current_timestamp(), text_col))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
