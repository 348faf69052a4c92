"""Lempel-Ziv phrase fingerprints (after Ziv and Lempel, 1978, and Raff and Nicholas, 2017).

The parse takes words as symbols. With characters as symbols one changed letter moves the phrase borders of all that
follows, and copies with a few changed words share about half their phrases, little more than unrelated texts of one
language; over words the borders fall back into step at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.buckets import HOT, linked, match_similarity
from textguard.llm.common import KEY, key, written

#: 16 bands of 4 minimum hashes; alike from an estimated phrase-set similarity of 0.7.
BANDS, ROWS, LEAST = 16, 4, 0.7
_MASK, _STEP = (1 << 61) - 1, 0x1F3D5B79A1C3E5F


def phrases(words: list[int]) -> list[int]:
    """Names of the phrases of an LZ78 parse: each is the longest known phrase and one more word. A last phrase that
    is known already adds nothing."""
    known: set[int] = set()
    add, current = known.add, 0
    for w in words:
        current = (current * _STEP + w) & _MASK
        if current not in known:
            add(current)
            current = 0
    return list(known)


def _parsed(n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = K.spans(part, off, K.WORD)
                names = (K.name(K.prefix(part), starts, ends) >> np.uint64(3)).tolist()
                sets = [phrases(names[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                flat = K.mix(np.array([x for s in sets for x in s], np.uint64))
                has = np.diff(first) > 0
                sig = K.minhash(flat, first, n_bands * rows)
                same = np.add.reduceat(K.mix(flat), first[:-1][has]) if has.any() else np.zeros(0, np.uint64)
                # a byte of the mixed hash: the minimum's own high bits are near 0 in every long text
                sk = (K.mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                own = np.zeros(j - i, np.int64)
                own[has] = same.view(np.int64)
                ends = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)  # a text without phrases has no bands and no bytes
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(first)),
                        pa.array(own),
                        pa.ListArray.from_arrays(pa.array(ends * n_bands), pa.array(K.bands(sig, rows).ravel())),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends * (n_bands * rows)), pa.py_buffer(sk.tobytes())]),
                    ],
                    names=["node", "n_phrases", "same", "bands", "sketch"],
                )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_bands: int = BANDS, rows: int = ROWS, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, n_phrases, fingerprint, group_id): every document's phrase count, the low-precision minimum hashes of
    its phrase set (hexadecimal), and the smallest document of its group, null if it is alike no other.

    Words are runs of letters and digits in lower case. The share of equal minimum hashes (a byte of each), less what
    chance gives, estimates the Jaccard similarity of phrase sets; bands choose the pairs that are compared, those of
    at least `least` are linked, and groups are connected components. Phrases go by 61-bit names, so two phrases of n
    in all are taken for one with probability n * n / 2^62.

    A text without words, empty or null, has no phrases: its row has n_phrases 0, fingerprint '' and no group.
    Rows that repeat an id and a text are one document and give one row; rows of one id and several texts give a row
    each. doc_id is the number of common.node; an empty table gives an empty one; other columns aren't read.
    """
    keyed = docs.select(key(id_col, text_col).alias("node"), F.lower(F.col(text_col)).alias("text"))
    table = written(keyed.mapInArrow(_parsed(n_bands, rows), f"node {KEY}, n_phrases long, same long, bands array<long>, sketch binary"), "sketches")
    comp = linked(table.where("n_phrases > 0").drop("n_phrases"), match_similarity, least, hot).select(F.col("node").alias("n"), F.col("comp.id").alias("group_id"))
    each = table.select("node", "n_phrases", F.hex("sketch").alias("fingerprint")).dropDuplicates(["node"])
    return each.join(comp, F.col("node") == F.col("n"), "left").select(F.col("node.id").alias("doc_id"), "n_phrases", "fingerprint", "group_id")
