"""Benchmark decontamination by Wu-Manber multi-pattern search (Wu and Manber, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.common import fresh, node

#: Test strings of 13 words; items of 6 to 12 words are test strings themselves; blocks of up to 12 bytes.
WORDS, LEAST_WORDS, BLOCK = 13, 6, 12
#: Bytes of benchmark text whose tables one search may broadcast, and a worker hold; a larger benchmark is searched in
#: parts, with the same rows.
PART_BYTES = 4 << 20


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words (letters and digits, lower case already) joined and enclosed by single spaces: bytes and offsets."""
    buf, offsets = K.text_bytes(column)
    part, off = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
    on = K.WORD[part]
    starts, ends, bounds = K.spans(part, off, K.WORD)
    keep = on.copy()
    inner = ends[ends < len(part)]
    keep[inner[~on[inner]]] = True  # the separator after a word becomes its space
    out = np.where(on, part, np.uint8(32))
    # a word at the end of a row, or right before another row's word, has no separator byte of its own
    tight = ends[(ends == len(part)) | np.isin(ends, off[1:], assume_unique=False)]
    at = np.concatenate([[0], np.cumsum(keep)])
    # row borders fall on bytes: separators that belong to the next row must not be its space
    keep[tight[tight < len(part)][~on[tight[tight < len(part)]]]] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    n_rows = len(off) - 1
    kept = out[keep]
    extra_at = at[tight]  # a space is put in here
    lead_rows = np.arange(n_rows)
    lead_at = at[off[:-1]]
    where = np.concatenate([extra_at, lead_at])
    order = np.concatenate([np.searchsorted(off[1:], tight, side="left") * 2 + 1, lead_rows * 2])
    o = np.lexsort((order, where))
    text = np.insert(kept, where[o], np.uint8(32))
    grown = at[off] + np.concatenate([np.searchsorted(np.sort(order[: len(tight)] // 2), np.arange(n_rows + 1), side="left")]) + np.arange(n_rows + 1)
    return text, grown


def test_strings(items: list[tuple[int, bytes]], words: int = WORDS, least_words: int = LEAST_WORDS) -> list[tuple[bytes, tuple[int, ...]]]:
    """(test string, all items that hold it) of normalised items: every run of `words` words, or the whole of a
    shorter item."""
    out: dict[bytes, tuple[int, ...]] = {}
    for item, text in sorted(items):
        w = text.split()
        if len(w) < least_words:
            continue
        for i in range(max(1, len(w) - words + 1)):
            key = b" " + b" ".join(w[i : i + words]) + b" "
            held = out.get(key, ())
            if not held or held[-1] != item:  # items come in order
                out[key] = (*held, item)
    return sorted(out.items())


class WuManber:
    """Searches bytes for patterns. `m` bytes of each pattern decide; shifts and buckets go by the block's content."""

    def __init__(self, patterns: list[tuple[bytes, tuple[int, ...]]], block: int = BLOCK):
        self.m = min(len(p) for p, _ in patterns)
        self.block = b = min(block, max(2, self.m // 2))
        self.most = self.m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = {}
        self.patterns = patterns
        for k, (p, _) in enumerate(patterns):
            for j in range(self.m - b + 1):
                key, s = p[j : j + b], self.m - b - j
                if s < self.shift.get(key, self.most):
                    self.shift[key] = s
            self.bucket.setdefault(p[self.m - b : self.m], {}).setdefault(p[: self.m], []).append(k)

    def search(self, text: bytes, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence within text[lo:hi]."""
        hi = len(text) if hi is None else hi
        found, b, m, most, shift = [], self.block, self.m, self.most, self.shift.get
        at = lo + m
        while at <= hi:
            s = shift(text[at - b : at], most)
            if not s:
                for k in self.bucket[text[at - b : at]].get(text[at - m : at], ()):
                    p = self.patterns[k][0]
                    if at - m + len(p) <= hi and text.startswith(p, at - m):
                        found.append((at - m, k))
                s = 1
            at += s
        return found


def _searchers(patterns: list[tuple[bytes, tuple[int, ...]]]) -> list[WuManber]:
    """Short patterns have tables of their own, as the shortest one bounds the shifts of all."""
    halves = [[p for p in patterns if (len(p[0]) < 32) == small] for small in (False, True)]
    return [WuManber(h) for h in halves if h]


def _find(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = None
        for batch in batches:
            searchers = searchers or _searchers(patterns.value)
            offsets = K.text_bytes(batch.column(1))[1]
            for i, j in K.slices(offsets):
                text, off = _normal(batch.column(1).slice(i, j - i))
                data, found = text.tobytes(), []
                for r, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    per: dict[int, int] = {}
                    for s in searchers:
                        for _, k in s.search(data, lo, hi):
                            for item in s.patterns[k][1]:
                                per[item] = per.get(item, 0) + 1
                    found += [(r, item, n) for item, n in per.items()]
                nodes = batch.column(0).slice(i, j - i)
                cols = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["doc_id", "item_id", "hits"]
                )

    return run


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, off = _normal(batch.column(1))
        data = text.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())], names=["item_id", "text"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, least_words: int = LEAST_WORDS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, item_id, hits): documents with test strings of a benchmark item, and how often.

    Text and items compare as words (runs of letters and digits, lower case). An item's test strings are its runs of
    `words` words, so any `words` words in a row count; an item of fewer words is one test string, of fewer than
    `least_words` none, as it would occur by chance. A test string of several items counts for each of them.

    Null and empty texts and items hold nothing; a null item id counts as -1; repeated items count once and repeated
    documents give repeated rows summed up; doc_id is the key of textguard.llm.common.node. Empty tables give an
    empty result. A benchmark of more than `part_bytes` is searched in parts of whole items, each read from the documents anew.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("item_id"), F.lower(F.col(item_text_col)).alias("text")).distinct()
    clean = items.mapInArrow(_normalised, "item_id long, text binary")
    total = clean.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    keyed = docs.select(node(id_col, text_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    out = None
    for k in range(parts):
        mine = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else clean
        patterns = test_strings([(r[0], bytes(r[1])) for r in mine.collect()], words, least_words)
        if patterns:
            found = keyed.mapInArrow(_find(spark.sparkContext.broadcast(patterns)), "doc_id long, item_id long, hits long")
            out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, hits long")
    return out.groupBy("doc_id", "item_id").agg(F.sum("hits").alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without those that `contaminated` finds; all columns and repeated rows stay as they are."""
    key, gone = fresh(docs, "_key"), fresh(docs, "_gone")
    found = contaminated(docs, benchmark, id_col, text_col, **settings).select(F.col("doc_id").alias(gone)).distinct()
    return docs.withColumn(key, node(id_col, text_col)).join(found, F.col(key) == F.col(gone), "left_anti").select(*docs.columns)
