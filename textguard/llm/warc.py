"""WARC files: a Spark-native writer, and a split reader that verifies record boundaries by chains.

A record's magic can stand inside a payload, so a task that starts in the middle of a file can't know which of the
magics it sees are records. Each task emits all its candidates with the offset of their successor, contracted to the
offset at which the chain leaves the task's split; pointer jumping from offset 0 then finds, in a number of rounds
logarithmic in the splits of a file, the one entry by which the true chain comes into each split. Only records on
that chain are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import drop, written

SPLIT = 8 << 20
MAGIC = b"WARC/1."
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)
_READ = 1 << 16


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes one response record per row, in a file per partition, through Spark's text writer and commit protocol.

    A null id or URL has no header of its own; line breaks in a URL become spaces; a null body is an empty block.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col(url_col), "[\r\n]", " "), F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"), F.lit(">\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    pages.select(F.concat(header, body).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


class _File:
    """Ranges of a file of any file system that Arrow knows."""

    def __init__(self, path: str):
        path = re.sub(r"^file:/+", "file:///", path).replace("s3a://", "s3://")
        where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = where.open_input_file(inner)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""


def _header(file: _File, data: bytes, base: int, at: int) -> tuple[bytes, int, int] | None:
    """(header, start of the block, offset of the successor) of the record that may start at `at`, or None."""
    i = at - base
    end = data.find(b"\r\n\r\n", i)
    if end < 0:  # the header goes on beyond what was read
        own, more = data[i:], _READ
        while (end := own.find(b"\r\n\r\n")) < 0:
            part = file.read(at + len(own), more)
            if not part:
                return None
            own += part
            more *= 2
        head = own[: end + 4]
    else:
        head = data[i : end + 4]
    if not head.startswith(MAGIC) or not (length := _LENGTH.search(head)):
        return None
    block = at + len(head)
    after = block + int(length[1])
    if file.read(after, 4) != b"\r\n\r\n" if after + 4 - base > len(data) else data[after - base : after + 4 - base] != b"\r\n\r\n":
        return None
    return head, block, after + 4


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, leaves): every candidate of a split, and where its chain leaves the split; a chain that ends at no
    candidate leaves nowhere and isn't emitted."""
    for batch in batches:
        for row in batch.to_pylist():
            file = _File(row["path"])
            lo, hi = row["lo"], row["hi"]
            data = file.read(lo, hi - lo + len(MAGIC))
            found = []
            at = data.find(MAGIC)
            while 0 <= at < hi - lo:
                if h := _header(file, data, lo, lo + at):
                    found.append((lo + at, h[2]))
                at = data.find(MAGIC, at + 1)
            leaves: dict[int, int] = {}
            for at, nxt in reversed(found):
                out = nxt if nxt >= hi or nxt >= file.size else leaves.get(nxt)
                if out is not None:
                    leaves[at] = out
            rows = sorted(leaves.items())
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["path", "at", "leaves"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the chain from a split's entry to the split's end and gives the records."""
    names = ["path", "offset", "record_type", "url", "page_id", "content"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def field(head: bytes, key: bytes) -> str | None:
        m = re.search(rb"\r\n" + key + rb":[ \t]*([^\r\n]*)", head, re.I)
        return m[1].decode("utf-8", "replace").strip() if m else None

    for batch in batches:
        for row in batch.to_pylist():
            file, at, held, size = _File(row["path"]), row["at"], [], 0
            base, data = at, file.read(at, row["hi"] - at + _READ)
            while at < row["hi"] and (h := _header(file, data, base, at)):
                head, block, nxt = h
                content = data[block - base : nxt - 4 - base]
                if len(content) < nxt - 4 - block:
                    content = file.read(block, nxt - 4 - block)
                own = re.fullmatch(r"<urn:page:(-?\d+)>", field(head, b"warc-record-id") or "")
                held.append((row["path"], at, field(head, b"warc-type"), field(head, b"warc-target-uri"), int(own[1]) if own else None, content))
                size += len(content)
                at = nxt
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def read_warc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, offset, record_type, url, page_id, content) of the records of uncompressed WARC files under `path`.

    A record starts with "WARC/1.", has a Content-Length and ends, after its block, with two line ends. Records are
    those that the chain from the file's start reaches; magics inside payloads aren't. A file that breaks off or
    whose chain meets something else gives the records before. Empty files and folders give none. A record may be
    longer than a split; `page_id` is null where the record id isn't one of write_warc.
    """
    if split < 1:
        raise ValueError("split is at least 1")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    splits = written(files.select("path", "length", lo.alias("lo")).withColumn("hi", F.least(F.col("lo") + split, "length")), "splits")
    most = splits.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    spread = splits.repartition(max(1, min(splits.count(), 100_000)), "path", "lo")
    hops = written(spread.select("path", "lo", "hi").mapInArrow(_candidates, "path string, at long, leaves long"), "hops")
    reached = written(splits.where("lo = 0").select("path", F.lit(0).cast("long").alias("at")), "reached")
    done = 1
    while done < most:
        jump = hops.select(F.col("path").alias("p"), F.col("at").alias("a"), "leaves")
        there = reached.join(jump, (F.col("path") == F.col("p")) & (F.col("at") == F.col("a"))).select("path", F.col("leaves").alias("at"))
        grown = written(reached.union(there).distinct(), "reached")
        done *= 2
        if done < most:
            onward = hops.join(jump.withColumnRenamed("leaves", "further"), (F.col("path") == F.col("p")) & (F.col("leaves") == F.col("a"))).select("path", "at", F.col("further").alias("leaves"))
            longer = written(onward, "hops")
            drop(hops)
            hops = longer
        drop(reached)
        reached = grown
    at_split = (F.floor(F.col("at") / F.lit(split)) * F.lit(split)).cast("long")
    ends = splits.select(F.col("path").alias("p"), "lo", "hi")
    entries = reached.withColumn("lo_", at_split).join(ends, (F.col("path") == F.col("p")) & (F.col("lo_") == F.col("lo")))
    spread = entries.select("path", "at", "hi").repartition(max(1, min(splits.count(), 100_000)), "path", "at")
    return spread.mapInArrow(_records, "path string, offset long, record_type string, url string, page_id long, content binary")
