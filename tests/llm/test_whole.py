"""Cases in which an operator once did less than its whole job."""

import random
import re

import pyarrow as pa
import pytest

from textguard.llm import decontam, suffix, toxicity, urls
from textguard.llm import kernel as K
from textguard.session import ship


def test_decontamination_gives_every_item_of_a_string(spark):
    ship(spark)
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:30])), (3, " ".join(w[5:30])), (4, " ".join(w[:8])), (5, " ".join(w[:8])), (5, " ".join(w[:20]))]
    docs = [(10, " ".join(w)), (11, " ".join(w[4:19])), (12, "x " + " ".join(w[:8]) + " y")]

    def strings(text):
        t = re.findall(r"\w+", text)
        return {" " + " ".join(t[i : i + 13]) + " " for i in range(max(1, len(t) - 12))}

    brute = {}
    for d, text in docs:
        for item in {i for i, _ in items}:
            held = set().union(*(strings(t) for i, t in items if i == item))
            if n := sum(f" {text} ".count(s) for s in held):
                brute[d, item] = n
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (1 << 20, 100, 1):
        assert {(r.doc_id, r.item_id): r.hits for r in decontam.contaminated(*tables, part_bytes=part_bytes).collect()} == brute


@pytest.fixture(scope="module")
def decode():
    text = "you are a stupid idiot and an ass or not so wise " * 200
    b = next(toxicity.trigram_counts(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])))
    return toxicity.Decoder(toxicity.log_model(b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)))


@pytest.mark.parametrize(
    "text, word",
    [("iidiioott", "idiot"), ("@$$", "ass"), ("455", "ass"), ("st-up-id", "stupid"), ("id.iot", "idiot"), ("st’up’id", "stupid"), ("idio+", "idiot"), ("st up id", "stupid"), ("s tu p i d", "stupid"), ("id iot", "idiot"), ("you id iot", "idiot"), ("5t up 1d", "stupid"), ("s t u p i d", "stupid"), ("st0pid 1diot", "idiot")],
)
def test_toxicity_restores_whatever_the_lattice_can_undo(decode, text, word):
    part, off = K.text_bytes(pa.array(["wise", f"so {text} and", ""]))
    joined, starts, ends, rows, plain = toxicity._words(part, off, decode)
    assert word in {joined[s:e].tobytes().decode() for s, e, r in zip(starts[plain:], ends[plain:], rows[plain:]) if r == 1}


def test_toxicity_counts_a_spaced_word_once(decode):
    joined, starts, ends, _, plain = toxicity._words(*K.text_bytes(pa.array(["you s t u p i d"])), decode)
    assert [joined[s:e].tobytes() for s, e in zip(starts[plain:], ends[plain:])] == [b"stupid"]


def test_toxicity_keeps_every_feature_with_evidence(spark):
    ship(spark)
    draw = random.Random(1)
    words = ["".join(draw.choices("bcdfghjklmnpqrstvwxyz", k=12)) for _ in range(800)]
    rare = words[700:]
    docs = [(i, " ".join(words if i < 20 else words[:700])) for i in range(60)] + [(100 + i, "plain words of a clean text") for i in range(1000)]
    labels = [(i, int(i < 100)) for i, _ in docs]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score(spark.createDataFrame([(" ".join(rare),)], "text string"), model).first()
    assert found.hits_ >= len(rare)


@pytest.mark.parametrize("q", [3, 5, 7])
def test_passages_by_several_rounds(spark, q):
    ship(spark)
    draw, words = random.Random(2), 20
    assert len(suffix._steps(words, q)) > 1
    texts = [draw.choices("abcdefgh", k=80) for _ in range(6)]
    for i, j, a, b, n in [(0, 1, 3, 40, 30), (1, 2, 50, 0, 20), (0, 3, 60, 60, 20), (2, 4, 10, 5, 19), (4, 5, 30, 30, 45)]:
        texts[j][b : b + n] = texts[i][a : a + n]
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - words + 1):
            where.setdefault(tuple(t[i : i + words]), []).append((d, i))
    shared = {x for at in where.values() if len({d for d, _ in at}) > 1 for x in at}
    brute = {(d, w) for d, i in shared for w in range(i, i + words)}
    rows = suffix.repeated_passages(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string"), words=words, q=q).collect()
    assert brute and {(r.doc_id, w) for r in rows for w in range(r.start_word, r.end_word)} == brute


def test_url_tree_has_all_levels(spark):
    ship(spark)
    pages = [(i, f"http://h.example.com/a/b/c/{'bad' if i % 2 else 'good'}/x/{i}") for i in range(80)]
    labels = [(i, i % 2) for i in range(80)]
    found = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "label_id long, bad int")).collect()
    assert len(found) == 80 and all(r.rejected == bool(r.page_id % 2) for r in found)
    assert {r.template for r in found} == {"/a/b/c/bad/x/<num>", "/a/b/c/good/x/<num>"}
