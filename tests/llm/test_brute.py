"""The operators against brute force on small fixtures: what they find, and that they find nothing else."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textguard.llm import bpe, buckets, fingerprint, lines, neardup, quality, toxicity, urls
from textguard.llm import kernel as K
from textguard.session import ship


def phrases_of(text):
    known, now = set(), ()
    for w in re.findall(r"\w+", text.lower()):
        now = (*now, w)
        if now not in known:
            known.add(now)
            now = ()
    return known


def jaccard(a, b):
    return len(a & b) / len(a | b)


def frame(spark, rows, schema="doc_id long, text string"):
    return ship(spark).createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [200, 2000, 20_000])
def test_fingerprints_link_what_shares_phrases_and_nothing_else(spark, size):
    draw = random.Random(size)
    docs = []
    for k in range(6):
        base = [f"{draw.choice('abcdefgh')}{draw.randrange(3 * size)}" for _ in range(size)]
        near, far = list(base), list(base)
        for i in draw.sample(range(size), size // 50):
            near[i] = f"x{i}"
        for i in draw.sample(range(size), size // 2):
            far[i] = f"y{i}"
        docs += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    sets = {d: phrases_of(t) for d, t in docs}
    rows = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, docs)).collect()}
    assert {d: r.n_phrases for d, r in rows.items()} == {d: len(s) for d, s in sets.items()}
    assert len({r.fingerprint for r in rows.values()}) == len(docs)
    for a, b in itertools.combinations(sets, 2):
        true, one = jaccard(sets[a], sets[b]), rows[a].group_id is not None and rows[a].group_id == rows[b].group_id
        assert one or true < 0.85
        assert not one or true > 0.5
        own = np.frombuffer(bytes.fromhex(rows[a].fingerprint), np.uint8), np.frombuffer(bytes.fromhex(rows[b].fingerprint), np.uint8)
        assert abs(float(buckets.match_similarity(own[0], own[1][None])[0]) - true) < 0.3


def test_line_dedup_keeps_the_lines_of_every_text_of_an_id(spark):
    rows = [(0, "the line that all of the texts have in common"), (1, "unique alpha line of the first text\nsecond line of the first text"), (1, "the line that all of the texts have in common\nthird line of the other text")]
    left = sorted(r.text for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert left == sorted([rows[0][1], rows[1][1], "third line of the other text"])


def brute_lines(docs):
    """The documents of which one line of every class of alike lines is left."""
    where, sets = {}, {}
    for d, text in sorted(docs):
        for k, x in enumerate(text.split("\n")):
            b = x.lower().strip().encode()
            if b:
                where.setdefault(b, []).append((d, k))
                sets[b] = {b[i : i + 8] for i in range(len(b) - 7)}
    up = {b: b for b in where}

    def top(b):
        while up[b] != b:
            b = up[b]
        return b

    for a, b in itertools.combinations(where, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    first = {}
    for b, at in where.items():
        first[top(b)] = min(first.get(top(b), at[0]), *at)
    gone = {x for b, at in where.items() for x in at if x != first[top(b)]}
    return {(d, left) for d, t in docs if (left := "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)).strip()}


@pytest.mark.parametrize("settings", [{"n_bands": 24, "rows": 2}, {"n_bands": 24, "rows": 2, "hot": 4}])
def test_line_dedup_is_brute_force(spark, settings):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(draw.choices(words, k=12)) for _ in range(120)]
    near = [b + f" {i}" for i, b in enumerate(base[:60])] + [b.upper() for b in base[60:80]] + [base[0][:-k] for k in range(1, 12)] + ["short", "Short ", ""]
    pool = base + near
    docs = [(d, "\n".join(draw.choices(pool, k=6))) for d in range(80)]
    assert {(r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, docs), **settings).collect()} == brute_lines(docs)


def test_near_duplicates_links_are_alike(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (r.text or "").lower())
        sets[r.doc_id] = set(zip(w, w[1:])) or {tuple(w)}
    comp = {r.node: r.comp for r in neardup.near_duplicates(docs).collect()}
    assert comp
    for d, c in comp.items():
        assert max(jaccard(sets[d], sets[x]) for x in comp if comp[x] == c and x != d) >= 0.5


def test_hot_buckets_give_the_same_groups(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    for find in (lambda **s: neardup.near_duplicates(docs, **s), lambda **s: fingerprint.fingerprints(docs, **s)):
        assert sorted(map(tuple, find(hot=2).collect()), key=str) == sorted(map(tuple, find().collect()), key=str)


def test_near_duplicates_of_one_id_and_ids_that_are_text(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [("7", a), ("x", b), ("x", a), ("y", None), ("y", None), ("7", a)]
    left = neardup.drop_near_duplicates(frame(spark, rows, "doc_id string, text string")).collect()
    assert sorted(r.text or "" for r in left) == sorted(["", "", a, b])
    docs = [(1, a), (2, b), (2, a + " c")]
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(frame(spark, docs)).collect()) == [(1, a), (2, b)]


def test_importance_is_brute_force(spark):
    draw, mask = random.Random(4), (1 << 64) - 1
    docs = [(i, " ".join(draw.choices(["alpha", "beta", "gamma", "delta,", "no no", "x!"], k=draw.randint(1, 30)))) for i in range(60)] + [(60, ""), (61, None)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(40)]
    n = 97

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def name(b):
        return mix((sum(int(K._BYTES[c]) * pow(K._BASE, i, 1 << 64) for i, c in enumerate(b)) + len(b)) & mask)

    def counted(text):
        w = [name(x.encode()) for x in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        two = [mix(0xABCDEF if a == b else (b * 0x9E3779B97F4A7C15 & mask) ^ a) for a, b in zip(w, w[1:])]
        return [x % n for x in w + two]

    raw, target = [0] * n, [0] * n
    for d, t in docs:
        for x in counted(t):
            raw[x] += 1
            target[x] += d < 40 and d % 3 == 0
    q = [r / sum(raw) for r in raw]
    p = [q[k] * (target[k] + quality.PRIOR) / (sum(target) * q[k] + quality.PRIOR) for k in range(n)]
    brute = {d: sum(math.log(p[x] / sum(p) / q[x]) for x in counted(t)) for d, t in docs}
    tables = frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int")
    own = quality.log_weights(*tables, buckets=n).withColumn("key", F.col("log_weight") + quality.gumbel(3)).collect()
    assert {r.doc_id: pytest.approx(r.log_weight, abs=1e-9) for r in own} == brute
    top = sorted((-r.key, r.hash, r.doc_id) for r in own)[: -(-len(docs) * 2 // 5)]
    found = quality.importance_sample(*tables, share=0.4, seed=3, buckets=n).collect()
    assert {r.doc_id for r in found} == {d for _, _, d in top}


def test_gumbel_is_the_law_it_says(spark):
    x = [r[0] for r in spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("hash")).select(quality.gumbel(1)).collect()]
    assert abs(np.mean(x) - 0.5772) < 0.03 and abs(np.var(x) - math.pi**2 / 6) < 0.06


@pytest.fixture(scope="module")
def decode():
    text = "you are a stupid idiot and an ass or not so wise " * 200
    b = next(toxicity.trigram_counts(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])))
    return toxicity.Decoder(toxicity.log_model(b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)))


@pytest.mark.parametrize("token", ["1d10t", "st-u", "@$$", "aass", "s t", "n0t", "or!", "w1s3"])
def test_decoder_finds_the_best_path_of_all(decode, token):
    """Every path through the lattice, scored by itself."""
    best = (-1e9, "")
    for path in itertools.product(*[decode.arcs(token, i) for i in range(len(token))]):
        state, score, out = (toxicity.END, toxicity.END), 0.0, ""
        for x, lp in path:
            score += lp
            s = toxicity.symbol(x) if x else None
            if s is None or (s == toxicity.END and state[1] == toxicity.END):
                continue
            score += decode.model[(state[0] * toxicity.SYMBOLS + state[1]) * toxicity.SYMBOLS + s]
            state, out = (state[1], s), out + x
        if state[1] != toxicity.END:
            score += decode.model[(state[0] * toxicity.SYMBOLS + state[1]) * toxicity.SYMBOLS + toxicity.END]
        best = max(best, (score, out.strip()))
    assert decode(token) == best[1]


def test_decoder_takes_a_very_long_token(decode):
    assert decode("st0pid" * 50_000).startswith("stopid") or decode("st0pid" * 10)


def test_toxicity_scores_by_words_of_evidence(spark):
    docs = [(i, "you absolute grobbler of a person" if i < 30 else "a kind and gentle person you are") for i in range(200)] + [(500, "what a gr0bbler"), (501, "so kind"), (502, None), (503, "")]
    labels = [(i, int(i < 30)) for i in range(200)]
    tables = frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxic_documents(*tables).collect()}
    assert set(found) == {*range(30), 500} and found[500].restored >= 1
    left = toxicity.drop_toxic(tables[0].withColumn("score_", F.lit(1)).withColumn("lower_", F.lit(2)), tables[1])
    assert left.columns == ["doc_id", "text", "score_", "lower_"] and {r.doc_id for r in left.collect()} == {*range(30, 200), 501, 502, 503}


def test_long_words_are_encoded_as_short_ones(monkeypatch):
    encode, draw = bpe.Encoder(bpe.ranks()), random.Random(3)
    for k in range(200):
        word = bytes(draw.choices(b"abeit ingoher" if k % 2 else range(256), k=draw.randint(64, 160)))
        own = encode(word)
        monkeypatch.setattr(bpe, "LONG", 1 << 40)
        assert encode(word) == own
        monkeypatch.undo()


def test_a_megabyte_without_a_space_is_encoded(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    row = bpe.round_trip(frame(spark, [(1, text)])).first()
    assert row.same and row.n_tokens > 1000


def test_token_ids_dont_depend_on_parts(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, group_bytes=20_000, part_bytes=10_000).collect()} == own


def test_unlabelled_branches_dont_tie_others(spark):
    pages, labels, k = [], [], 0
    for name, n, bad in [("good", 100, 20), ("bad", 100, 70), ("none", 30, None)]:
        for i in range(n):
            pages.append((k, f"http://h.example.com/{name}/{k}"))
            labels += [(k, int(i < bad))] if bad is not None else []
            k += 1
    rows = urls.judge_urls(frame(spark, pages, "page_id long, url string"), frame(spark, labels, "label_id long, bad int")).collect()
    by = {r.url.split("/")[3]: r for r in rows}
    assert len({r.template for r in by.values()}) == 3 and by["bad"].rejected and not by["good"].rejected


def test_template_names_stay_short(spark):
    pages = [(i, f"http://h.example.com/{i % 15}s/{i}") for i in range(3000)]
    rows = urls.judge_urls(frame(spark, pages, "page_id long, url string"), frame(spark, [(0, 0)], "label_id long, bad int")).collect()
    assert {r.template for r in rows} == {"/0s|+14/<num>"}
