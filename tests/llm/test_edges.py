"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from textguard.llm import bpe, decontam, fingerprint, lines, neardup, quality, suffix, toxicity, urls, warc
from textguard.llm.common import new_path
from textguard.session import ship

EXTRA = ["node", "same", "bands", "sketch", "key", "comp", "line", "at", "content", "_key", "_gone", "_rank", "score_", "hits_", "lower_", "hash", "words", "own"]
WORDS = " ".join(f"word{i % 997} w{i}" for i in range(30_000))
ROWS = [(1, "the cat sat on the mat and looked around\nsecond line of this text"), (1, "the cat sat on the mat and looked around\nsecond line of this text"), (2, None), (None, "a text without an id"), (None, None), (3, ""), (4, "  \n\t "), (5, WORDS), (6, WORDS), (7, "the cat sat on the mat and looked around\nsecond line of this text"), (8, "é ß 漢字 😀")]


@pytest.fixture(scope="module", params=["full", "empty"])
def tables(request, spark):
    ship(spark)
    docs = spark.createDataFrame(ROWS if request.param == "full" else [], "doc_id long, text string")
    docs = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in EXTRA])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 0)] if request.param == "full" else [], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked around"), (None, "x"), (2, None), (3, "")] if request.param == "full" else [], "item_id long, text string")
    return docs, labels, items, len(ROWS) if request.param == "full" else 0


def test_fingerprints(tables):
    docs, _, _, n = tables
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    if n:
        assert rows[1].fingerprint == rows[7].fingerprint and rows[1].group_id == rows[7].group_id == 1
        assert rows[3].n_phrases == 0 and rows[3].fingerprint == "" and rows[3].group_id is None
        assert rows[5].group_id == rows[6].group_id == 5
    assert bool(rows) == bool(n)


def test_importance(tables):
    docs, labels, _, n = tables
    assert quality.importance_sample(docs, labels, share=0.5).count() == -(-n // 2)


def test_passages(tables):
    docs, _, _, n = tables
    rows = suffix.repeated_passages(docs).collect()
    assert {r.doc_id for r in rows} == ({5, 6} if n else set())


def test_lines(tables):
    docs, _, _, n = tables
    out = lines.dedup_lines(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    if n:
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r.text)
        assert by[1] == [ROWS[0][1]] * 2 and 7 not in by and 6 not in by and by[2] == [None] and by[3] == [""] and by[4] == ["  \n\t "]
    else:
        assert rows == []


def test_near(tables):
    docs, _, _, n = tables
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    assert ids == ([1, 2, 3, 4, 5, 8, None, None] if n else [])
    assert {(r.doc_id, r.group_id) for r in neardup.report(docs).collect()} == ({(1, 1), (7, 1), (5, 5), (6, 5)} if n else set())


def test_decontamination(tables):
    docs, _, items, n = tables
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == ({(1, 1), (7, 1)} if n else set())
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns and out.count() == (n - 3 if n else 0)


def test_toxicity(tables):
    docs, labels, _, n = tables
    toxicity.toxic_documents(docs, labels).collect()
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() <= n


def test_bpe(tables):
    docs, _, _, n = tables
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == n and all(r.same for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows) and (not n or {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0})


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/x/1"), (1, "http://a.example.com/x/1"), (2, None), (3, ""), (4, "nonsense"), (None, "https://b.example.com")], "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "label_id long, bad int")
    rows = urls.judge_urls(pages, none).collect()
    assert len(rows) == 6 and not any(r.rejected for r in rows) and {r.host for r in rows if r.page_id in (2, 3, 4)} == {""}
    assert urls.judge_urls(pages.limit(0), none).count() == 0


def test_warc(spark):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/", "x" + magic * 3), (2, "http://b/", ""), (2, "http://b/", ""), (3, None, None), (4, "http://c/", "é" * 200_000 + magic)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    back = sorted((r.page_id, bytes(r.content or b"").decode()) for r in warc.read_warc(spark, path, split=10_000).collect())
    assert back == sorted((i, h or "") for i, _, h in rows)


def test_warc_empty(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_stages_take_any_table(spark, rows):
    """Nulls, empty and long texts, repeated rows, an empty table, clashing extra columns and no n_chars."""
    import corpus_pipeline

    ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(7).alias(c) for c in EXTRA])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        kept = out.select("doc_id", "text").collect()
        assert len(kept) <= len(rows) and set(map(tuple, kept)) <= set(rows)
        for blank in ("", None):
            assert sum(r.text == blank for r in kept) == sum(t == blank for _, t in rows)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert tokens.count() == len(rows)


def test_ids_that_are_no_numbers(spark):
    ship(spark)
    docs = spark.createDataFrame([("a", "one text of words"), ("b", "another text of words"), ("7", "a third one")], "doc_id string, text string")
    assert fingerprint.fingerprints(docs).select("doc_id").distinct().count() == 3
    assert len({r.doc_id for r in bpe.encode(docs).collect()}) == 3 and 7 in {r.doc_id for r in bpe.encode(docs).collect()}
    assert lines.dedup_lines(docs).count() == 3 and neardup.drop_near_duplicates(docs).count() == 3


def test_scratch_tables_go(spark):
    from textguard.llm import common

    ship(spark)
    docs = spark.createDataFrame([(1, "a text of words"), (2, "a text of words")], "doc_id long, text string")
    with common.scratch(spark):
        made = len(common._MADE)
        assert neardup.drop_near_duplicates(docs).count() == 1
        paths = common._MADE[made:]
        assert paths
    import os

    assert not [p for p in paths if os.path.exists(p.removeprefix("file://"))]
