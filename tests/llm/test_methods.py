"""The operators against brute force, other tokenizers and held-out labels."""

import base64
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import bpe, fingerprint, lines, neardup, toxicity
from textguard.session import ship

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.mark.parametrize("name", ["op3_repeated_passages", "op5_warc_round_trip", "op6_url_templates", "op8_decontamination"])
def test_sql(agrees, name):
    agrees(name)


def test_phrases_are_lempel_ziv():
    def brute(words):
        known, out, i = set(), [], 0
        while i < len(words):
            j = i + 1
            while j < len(words) and tuple(words[i:j]) in known:
                j += 1
            known.add(tuple(words[i:j]))
            out.append(tuple(words[i:j]))
            i = j
        return out

    words = [int(x) + 1000 for x in np.random.default_rng(1).integers(0, 4, 400)]
    assert len(fingerprint.phrases(words)) == len(set(brute(words)))


def test_near_duplicates_recall(docs):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (r.text or "").lower())
        sets[r.doc_id] = set(zip(w, w[1:]))
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    comp = {r.node: r.comp for r in neardup.near_duplicates(docs).collect()}
    found = sum(a in comp and comp[a] == comp.get(b) for a, b in pairs)
    assert pairs and found >= 0.95 * len(pairs)


def test_similar_lines_recall(docs):
    sets = {}
    for r in docs.collect():
        for x in (r.text or "").lower().split("\n"):
            b = x.strip(" \t\r\v\f").encode()
            if len(b) > 8:
                sets[b] = {b[i : i + 8] for i in range(len(b) - 7)}
    keys = list(sets)
    some = keys[:: max(1, len(keys) // 400)]
    pairs = [(a, b) for a in some for b in keys if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = "\n".join(r.text or "" for r in lines.dedup_lines(docs).collect()).lower()
    kept_lines = {x.strip(" \t\r\v\f").encode() for x in kept.split("\n")}
    both = sum(a in kept_lines and b in kept_lines for a, b in pairs)
    assert both <= 0.1 * len(pairs)


def test_decoder_restores_disguised_words(spark, docs):
    lower = docs.select(F.lower("text").alias("text"))
    rows = lower.mapInArrow(toxicity.trigram_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    decode = toxicity.Decoder(toxicity.log_model(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))
    assert decode("th3") == "the" and decode("t.h.e") == "the" and decode("thhhhe") == "the"


def test_toxicity_held_out(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels.where(~held)).collect()}
    rows = labels.where(held).collect()
    true = {r.doc_id for r in rows if r.toxic == 1}
    false = {r.doc_id for r in rows if r.toxic == 0}
    assert len(found & true) >= 0.9 * len(true) and len(found & false) <= 0.03 * len(false)


def test_bpe_equals_another_encoder(docs):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=known, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == other.encode_ordinary(texts[r.doc_id])


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = ship(spark).read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DATA)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= left.count()
        left = spark.createDataFrame(rows, docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r.doc_id for r in left.collect())
