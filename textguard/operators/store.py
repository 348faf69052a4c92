"""Fingerprint store of known texts: a table that is registered into, looked up, aged and counted by joins."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textguard.functions import text as T

TTL_DAYS, MOST, PREVIEW = 90, 50_000, 80
#: Least characters, share of tokens from which a text spikes, characters of a window and its share, and the share of
#: characters of dense scripts above which neither counts.
LEAST, SPIKE, WINDOW, LOCAL, DENSE = 10, 0.75, 50, 0.85, 0.3
DENSE_SCRIPT = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{1F300}-\x{1FAFF}\x{20000}-\x{2FA1F}]"
PIECE = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]{1,3}|[!-/:-@\[-`{-~]"
#: Both as Python writes them.
_PIECE, _DENSE = (re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)) for p in (PIECE, DENSE_SCRIPT))
FLAGS = {"content_hash": "known_malicious_exact", "normalized_hash": "known_malicious_normalized", "token_hash": "known_malicious_token_pattern"}
SCHEMA = "content_hash string, normalized_hash string, token_hash string, label string, ratio double, preview string, hit_count long, first_seen timestamp, last_seen timestamp"


def fingerprint(c: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Hashes and counts of a text. `tokens` is an array of token ids; without it words are counted and the token hash
    is empty."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))
    n = F.size(T.words(c) if tokens is None else tokens).cast("long")
    return {
        "content_hash": F.sha2(c, 256),
        "normalized_hash": F.sha2(norm, 256),
        "token_hash": F.lit("") if tokens is None else F.sha2(F.array_join(tokens.cast("array<string>"), ","), 256),
        "token_count": n,
        "char_count": F.length(c).cast("long"),
        "ratio": F.round(n / F.greatest(F.length(c), F.lit(1)), 4),
    }


def fingerprints(df: DataFrame, text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Adds the columns of `fingerprint`; a null text counts as empty."""
    return df.withColumns(fingerprint(T.text(text_col), F.col(tokens_col) if tokens_col else None))


def register(store: DataFrame, texts: DataFrame, now: Column, text_col: str = "text", label: str = "malicious", tokens_col: str | None = None) -> DataFrame:
    """The store with the texts that it doesn't hold yet; of equal texts one is added. Null texts aren't registered."""
    new = fingerprints(texts.where(F.col(text_col).isNotNull()), text_col, tokens_col)
    new = new.groupBy("content_hash").agg(*[F.min(c).alias(c) for c in ("normalized_hash", "token_hash", "ratio")], F.min(F.substring(text_col, 1, PREVIEW)).alias("preview"))
    new = new.join(store.select("content_hash"), "content_hash", "left_anti")
    return store.unionByName(new.select("content_hash", "normalized_hash", "token_hash", F.lit(label).alias("label"), "ratio", "preview", F.lit(0).cast("long").alias("hit_count"), now.alias("first_seen"), now.alias("last_seen")))


def check(prints: DataFrame, store: DataFrame) -> DataFrame:
    """Adds `flags`: which of the three hashes the store knows. Empty hashes match nothing."""
    for k in FLAGS:
        known = store.where(f"{k} <> ''").select(F.col(k).alias("k_")).distinct().withColumn(f"known_{k}", F.lit(True))
        prints = prints.join(known, F.col(k) == F.col("k_"), "left").drop("k_")
    flags = F.array_compact(F.array(*[F.when(F.col(f"known_{k}"), F.lit(v)) for k, v in FLAGS.items()]))
    return prints.withColumn("flags", flags).drop(*[f"known_{k}" for k in FLAGS])


def touch(store: DataFrame, prints: DataFrame, now: Column) -> DataFrame:
    """The store after the looked-up texts: each match of a column counts one hit and renews last_seen."""
    out = store.withColumn("more_", F.lit(0).cast("long"))
    for k in FLAGS:
        n = prints.where(f"{k} <> ''").groupBy(F.col(k).alias("k_")).agg(F.count("*").alias("n_"))
        out = out.join(n, F.col(k) == F.col("k_"), "left").withColumn("more_", F.col("more_") + F.coalesce("n_", F.lit(0))).drop("k_", "n_")
    return out.withColumn("last_seen", F.when(F.col("more_") > 0, now).otherwise(F.col("last_seen"))).withColumn("hit_count", F.col("hit_count") + F.col("more_")).select(*store.columns)


def prune(store: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Without entries not seen for `days`."""
    return store.where(F.col("last_seen") >= now - F.make_interval(days=F.lit(days)))


def evict(store: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` entries of most hits, the latest seen first; the cap is the store's feature."""
    return store.orderBy(F.desc("hit_count"), F.desc("last_seen"), "content_hash").limit(most)


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).cast("long").alias("total_hits"))


def migrate(content: DataFrame, normalized: DataFrame, token: DataFrame) -> DataFrame:
    """A store of three tables of an older format, (hash, preview) and of `content` also label, ratio, hit_count,
    first_seen and last_seen, that belong together by preview. Of several hashes of a preview the greatest counts."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("preview").agg(F.max("hash").alias(name))

    base = content.groupBy("preview").agg(F.max_by(F.struct(F.col("hash").alias("content_hash"), "label", "ratio", "hit_count", "first_seen", "last_seen"), "hash").alias("e"))
    joined = base.join(one(normalized, "normalized_hash"), "preview", "left").join(one(token, "token_hash"), "preview", "left")
    kept = joined.select("e.content_hash", F.coalesce("normalized_hash", F.lit("")).alias("normalized_hash"), F.coalesce("token_hash", F.lit("")).alias("token_hash"), F.coalesce("e.label", F.lit("malicious")).alias("label"), F.coalesce("e.ratio", F.lit(0.0)).alias("ratio"), "preview", F.coalesce("e.hit_count", F.lit(0)).cast("long").alias("hit_count"), "e.first_seen", "e.last_seen")
    return kept.dropDuplicates(["content_hash"])


def pieces(t: str) -> int:
    """A number of tokens without an encoder: runs of letters (all beyond ASCII count as letters), of up to three digits,
    and every sign by itself. Words can't stand for tokens, as there are at most half as many as characters."""
    return len(_PIECE.findall(t))


def anomalies_of(t: str, count: Callable[[str], int] = pieces) -> list[str]:
    """As `anomalies`; one pass over a text."""
    n = len(t)
    if n < LEAST or (not t.isascii() and len(_DENSE.findall(t)) > DENSE * n):
        return []
    if count(t) / n >= SPIKE:
        return ["tokenization_spike"]
    local = any(count(t[i : i + WINDOW]) / WINDOW >= LOCAL for i in range(0, n - WINDOW + 1, WINDOW))
    return ["tokenization_spike_local"] if local else []


def anomalies(c: Column, count: Callable[[str], int] = pieces) -> Column:
    """Flags of texts with very many tokens for their length, as a whole or in a window of 50 characters, in an Arrow
    batch; `count` gives a text's number of tokens, by an encoder if there is one."""
    @F.arrow_udf(ArrayType(StringType()))
    def flags(texts: pa.Array) -> pa.Array:
        return pa.array([anomalies_of(t or "", count) for t in texts.to_pylist()], pa.list_(pa.string()))

    return flags(c)
