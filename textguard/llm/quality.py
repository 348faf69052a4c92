"""Importance resampling with hashed n-gram models and Gumbel top-k (after Xie et al., 2023)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.common import node, written

#: Buckets of hashed unigrams and bigrams; labelled target documents at most; share of the documents that is sampled.
BUCKETS, TARGET_DOCS, SHARE, SEED = 10_000, 20_000, 0.85, 7
#: Counts by which a bucket's ratio is drawn to 1.
PRIOR = 5.0

_PUNCT = ~K.WORD & K.NONSPACE


def _tokens(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of words and of runs of punctuation in their order, and each row's first."""
    s1, e1, _ = K.spans(part, off, K.WORD)
    s2, e2, _ = K.spans(part, off, _PUNCT)
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return K.name(K.prefix(part), starts, ends), np.searchsorted(starts, off)


def _buckets(part: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of every unigram and bigram."""
    words, bounds = _tokens(part, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    within = row[1:] == row[:-1]
    # a bigram of one word twice is an event of its own, whatever the word: repetition generalises
    pair = np.where(words[1:] == words[:-1], np.uint64(0xABCDEF), words[1:] * np.uint64(0x9E3779B97F4A7C15) ^ words[:-1])
    names = np.concatenate([words, K.mix(pair[within])])
    return (names % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][within]])


def _counted(buckets: int):
    """(bucket, raw, target) of all texts, once per task; the second column says which belong to the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            buf, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                at, row = _buckets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[chosen[i:j][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _weighed(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            buf, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                at, row = _buckets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(table))
                weight = np.bincount(row, table[at], minlength=j - i).astype(float)  # of nothing it gives integers
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(weight)], names=["doc_id", "hash", "log_weight"])

    return run


def log_weights(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", buckets: int = BUCKETS, target_docs: int = TARGET_DOCS
) -> DataFrame:
    """(doc_id, hash, log_weight): the log ratio of a text under the target's and the raw texts' n-gram model.

    The raw model counts all documents; the target model counts documents labelled 1, at most `target_docs` of them
    in the order of a hash of their id. The target model is the raw one with each bucket's share times the ratio of
    counted to expected target n-grams, both with PRIOR more, so that a bucket the target can't speak for stays even.
    """
    spark = docs.sparkSession
    good = labels.where((F.col(label_col) == 1) & F.col(label_id).isNotNull()).select(F.col(label_id).cast("long").alias("g_")).distinct()
    good = good.orderBy(F.xxhash64("g_", F.lit("target"))).limit(target_docs)
    keyed = docs.select(node(id_col, text_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    marked = keyed.join(F.broadcast(good), F.col("doc_id") == F.col("g_"), "left").select("text", F.col("g_").isNotNull().alias("target"))  # bounded
    counts = marked.mapInArrow(_counted(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(buckets)
    if raw.sum() and target.sum():
        q = raw / raw.sum()
        p = q * (target + PRIOR) / (target.sum() * q + PRIOR)
        seen = raw > 0
        ratio[seen] = np.log(p[seen] / p.sum() / q[seen])
    held = spark.sparkContext.broadcast(ratio)
    return keyed.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(_weighed(held), "doc_id long, hash long, log_weight double")


def gumbel(seed: int) -> F.Column:
    """Gumbel noise that the document and the seed decide."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "hash", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def top_share(keyed: DataFrame, share: float, bins: int = 4096) -> DataFrame:
    """The ceil(share * rows) rows of largest `key`, ties by hash and doc_id; exact, without a global sort.

    The key's threshold is found by counting bins, each pass within the bin of the pass before; only the rows of
    the last bin are ranked.
    """
    n, low, high = keyed.agg(F.count("*"), F.min("key"), F.max("key")).first()
    k = min(n, -int(-share * n // 1))
    if not k:
        return keyed.limit(0)
    above = 0
    for _ in range(8):
        if not high > low:
            break
        width = (high - low) / bins
        inside = keyed.where((F.col("key") >= low) & (F.col("key") <= high))
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counted = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(counted, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, here = r["low"], r["high"], r["n"]
                break
            above += r["n"]
        if here <= 1000:
            break
    sure = keyed.where(F.col("key") > high)
    rest = keyed.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key"), "hash", "doc_id").limit(k - above)
    return sure.union(rest)


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = SEED, **settings) -> DataFrame:
    """(doc_id, log_weight, key): the sample of ceil(share * rows) documents without replacement, with probabilities
    in proportion to exp(log_weight): the largest sums (key) of log weight and Gumbel noise.

    Null and empty texts have log weight 0, the weight of a text that both models hold equally likely. Repeated rows
    have equal keys and are drawn row by row. Without labelled target documents all weights are 0 and the sample is
    even. doc_id is the key of common.node; an empty table gives an empty one; other columns aren't read.
    """
    if not 0 <= share <= 1:
        raise ValueError("share lies between 0 and 1")
    weights = written(log_weights(docs, labels, id_col, text_col, **settings).withColumn("key", F.col("log_weight") + gumbel(seed)), "weights")
    return top_share(weights, share).select("doc_id", "log_weight", "key")
