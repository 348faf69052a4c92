"""MinHash near-duplicates with odd sketches (Mitzenmacher, Pagh and Pham, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.buckets import HOT, linked, odd_similarity, odd_sketch
from textguard.llm.common import KEY, drop, fresh, key, written

#: Word bigrams; 24 bands of 4 minimum hashes; parity bitmaps of 256 bits; alike from an estimated Jaccard of 0.6.
SHINGLE, BANDS, ROWS, BITS, LEAST = 2, 24, 4, 256, 0.6


def _sketch(shingle: int, n_bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = K.spans(part, off, K.WORD)
                words = K.name(K.prefix(part), starts, ends)
                names, _, first = K.grams(words, bounds, shingle)
                sig = K.minhash(names, first, n_bands * rows)
                has = np.diff(first) > 0
                whole = K.grams(words, bounds, 1 << 40)[0]
                sk, keys = odd_sketch(sig, bits), K.bands(sig, rows)
                n = len(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).filter(pa.array(has)),
                        pa.array(whole.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (bits // 8)).astype(np.int32)), pa.py_buffer(sk.tobytes())]),
                    ],
                    names=["node", "same", "bands", "sketch"],
                )

    return run


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_bands: int, rows: int, bits: int) -> DataFrame:
    keyed = docs.select(key(id_col, text_col).alias("node"), F.lower(F.col(text_col)).alias("text"))
    return written(keyed.mapInArrow(_sketch(shingle, n_bands, rows, bits), f"node {KEY}, same long, bands array<long>, sketch binary"), "sketches")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, bits: int = BITS, least: float = LEAST, hot: int = HOT
) -> DataFrame:
    """(node, own, comp, comp_own): keys (number and text hash, common.key) of documents that are near another, with
    the smallest key of their group.

    Words are runs of letters and digits in lower case; a document's set holds its word n-grams of `shingle`
    words (a shorter document gives one gram). The n_bands * rows minimum hashes give the bands that choose
    candidates and the odd sketch whose XOR with another estimates the Jaccard similarity; pairs of an estimate of
    at least `least` are linked, and groups are connected components. Buckets of more than `hot` documents are worked
    off in chunks, with the same result.

    A document without words, empty or null, is near no other. A key is common.key: rows that repeat an id and a text
    are one document, rows of one id and several texts are several. An empty table gives an empty one; other columns
    aren't read.
    """
    table = _sketches(docs, id_col, text_col, shingle, n_bands, rows, bits)
    out = linked(table, odd_similarity(n_bands * rows, bits), least, hot)
    drop(table)
    return out.select("node.id", "node.own", F.col("comp.id").alias("comp"), F.col("comp.own").alias("comp_own")).withColumnRenamed("id", "node")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, bits: int = BITS, least: float = LEAST, hot: int = HOT
) -> DataFrame:
    """One document of each group stays, that of the smallest key; all columns are kept.

    Of rows that repeat an id and a text one stays, if the text has words. Rows of one id and several texts are
    documents of their own, and each stays unless it is near a document of a smaller key. Documents without words
    (null, empty) stay as they are. An empty table gives an empty one.
    """
    table = _sketches(docs, id_col, text_col, shingle, n_bands, rows, bits)
    # both written: their size decides whether the texts have to be shuffled for the joins
    losers = written(linked(table, odd_similarity(n_bands * rows, bits), least, hot).where("node <> comp").select("node"), "losers")
    repeated = written(table.groupBy("node").count().where("count > 1").select("node").join(losers, "node", "left_anti"), "repeated")
    drop(table)
    own, gone = fresh(docs, "_key"), fresh(docs, "_gone")
    kept = docs.withColumn(own, key(id_col, text_col)).join(losers.select(F.col("node").alias(gone)), F.col(own) == F.col(gone), "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = repeated.select(F.col("node").alias(gone))
    once = kept.join(again, F.col(own) == F.col(gone), "left_anti")
    return once.union(kept.join(again, F.col(own) == F.col(gone), "left_semi").dropDuplicates([own])).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, group_id, kept) for every document of a group of two or more: the numbers of common.node of the
    document and of the one that stays. Nulls, empty texts, repeated rows and empty tables: see near_duplicates."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    return found.select(F.col("node").alias("doc_id"), F.col("comp").alias("group_id"), F.expr("node = comp and own = comp_own").alias("kept"))
