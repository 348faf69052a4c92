"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted over all documents. Tokens with symbols that may stand for letters, with doubled
letters or with separators inside, and neighbours of at most PIECE characters, become a lattice (each symbol may stand
for letters, separators and repeats may drop), Viterbi decoding under the model picks the most likely reading, and the
readings join the plain words. The channel's costs are set by hand. Words are scored by weights
of whole words and word beginnings that labelled documents give, documents by a logistic model over their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.common import fields, fresh, node

#: Labelled documents that the classifier is fitted on, of each class at most.
TRAIN_TOXIC, TRAIN_CLEAN = 6000, 12000
#: Word beginnings (bytes) that are features; the least evidence (log odds) and documents of one.
STARTS, LEAST_WEIGHT, LEAST_DOCS = (4, 5, 6, 7, 8, 9, 10), 1.5, 3
THRESHOLD = 0.5
#: Characters of the pieces that are joined over spaces; of a word in longer pieces each piece stays a word.
PIECE = 3

SYMBOLS = 60  # a-z, U+00E0-U+00FF, other letters, and what ends a word
OTHER, END = 58, 59
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
_DROPS = ".-_*~'’ "
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0xC3, 0xF5)]] = True
_LEETS = np.zeros(256, bool)
_LEETS[[ord(c) for c in LEET if ord(c) < 128 and c not in "!(|+"]] = True
_SOFT = np.zeros(256, bool)  # symbols that count inside a token alone
_SOFT[[ord(c) for c in "!(|+"]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in ".-_*~'"]] = True

_SYMBOL = np.full(256, END, np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[0xC4:0xF5] = OTHER


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o < 123:
        return o - 97
    if 0xE0 <= o <= 0xFF:
        return 26 + o - 0xE0
    return OTHER if c.isalpha() else END


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of the character trigrams of a column of lower-case texts, once per task."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        buf, offsets = K.text_bytes(batch.column(0))
        for i, j in K.slices(offsets):
            part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                continue
            s = _SYMBOL[part]
            two = np.flatnonzero(part[:-1] == 0xC3)
            s[two] = 26 + (part[two + 1] & 0x1F)
            own = (part & 0xC0) != 0x80
            at = np.concatenate([[0], np.cumsum(own)])[off]
            s = s[own]
            # two ends before each document and one after it
            s = np.insert(s, np.repeat(at, 3), END)
            code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            total += np.bincount(code[~((s[1:-1] == END) & (s[2:] == END))], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])


def log_model(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and the letter shares."""
    c = np.zeros(SYMBOLS**3)
    c[code] = n
    c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = c.sum((0, 1)) + 1
    one /= one.sum()
    two = c.sum(0)
    p2 = (two + 10 * one) / (two.sum(-1, keepdims=True) + 10)
    return np.log((c + 5 * p2[None]) / (c.sum(-1, keepdims=True) + 5)).astype(np.float32)


class Decoder:
    """Viterbi over the lattice of a token; states are the last two symbols."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()
        self.seen: dict[str, list[bytes]] = {}
        self.known: dict[tuple[str, bool, bool], list[tuple[str, float, int]]] = {}  # arcs by what decides them

    def arcs(self, token: str, i: int) -> list[tuple[str, float]]:
        """What the i-th character may stand for ('' for nothing, ' ' for a word's end), with log probabilities."""
        c = token[i]
        out: list[tuple[str, float]] = []
        if c.isalpha():
            out.append((c, 0.0))
            if i and token[i - 1] == c:
                triple = (i > 1 and token[i - 2] == c) or (i + 1 < len(token) and token[i + 1] == c)
                out.append(("", -0.1 if triple else -6.0))
        elif c in LEET:
            out += [(x, -1.0) for x in LEET[c]]
            out.append((" ", -7.0))
            if i and token[i - 1] == c:
                out.append(("", -4.0))
        elif c in _DROPS:
            out += [("", -0.5), (" ", -2.0)]
        else:
            out.append((" ", 0.0))
        return out

    def __call__(self, token: str) -> str:
        model, known, n = self.model, self.known, len(token)
        best: dict[int, tuple[float, tuple | None]] = {END * SYMBOLS + END: (0.0, None)}  # a reading is a chain of (rest, last symbol)
        for i, c in enumerate(token):
            double = i > 0 and token[i - 1] == c
            key = c, double, double and ((i > 1 and token[i - 2] == c) or (i + 1 < n and token[i + 1] == c))
            if (arcs := known.get(key)) is None:
                arcs = known[key] = [(x, lp, symbol(x) if x else -1) for x, lp in self.arcs(token, i)]
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, chain) in best.items():
                last = state % SYMBOLS
                for x, lp, s in arcs:
                    if s < 0 or (s == END and last == END):
                        new = score + lp
                        if (old := nxt.get(state)) is None or new > old[0]:
                            nxt[state] = new, chain
                    else:
                        to, new = last * SYMBOLS + s, score + lp + model[state * SYMBOLS + s]
                        if (old := nxt.get(to)) is None or new > old[0]:
                            nxt[to] = new, (chain, x)
            best = nxt
        final = [(score + (0 if state % SYMBOLS == END else model[state * SYMBOLS + END]), chain) for state, (score, chain) in best.items()]
        chain, out = max(final, key=lambda x: x[0])[1], []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out)).strip()

    def restored(self, token: str) -> list[bytes]:
        """The words of a token's reading that the token itself doesn't hold."""
        found = self.seen.get(token)
        if found is None:
            found = [w.encode() for w in self(token).split() if w not in token]
            if len(self.seen) < 1 << 17:  # a cache alone: what isn't in it is decoded again
                self.seen[token] = found
        return found


def noisy_tokens(part: np.ndarray, off: np.ndarray) -> list[tuple[int, str, list[str]]]:
    """(row, token, runs) of the tokens, or runs of short pieces, that may be obfuscated; runs: the runs of single
    characters within a run of pieces, as other pieces beside them may hide how they read."""
    starts, ends, bounds = K.spans(part, off, K.NONSPACE)
    if not len(starts):
        return []

    def inside(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[ends] - c[starts]

    letter = _LETTER[part]
    n = len(part)
    same = np.zeros(n, bool)  # a letter of one or two bytes and the same again
    same[1:] = letter[1:] & (part[1:] == part[:-1]) & (part[1:] < 128)
    same[3:] |= (part[3:] & 0xC0 == 0x80) & (part[3:] == part[1:-2]) & (part[2:-1] == part[:-3]) & (part[2:-1] >= 0xC3) & (part[2:-1] < 0xE0)
    mark = _LEETS[part] | _SOFT[part]
    sep = _SEP[part]
    for c, of in (("€", mark), ("’", sep)):
        x, y, z = c.encode()
        of[2:] |= (part[2:] == z) & (part[1:-1] == y) & (part[:-2] == x)
    first = np.zeros(n, bool)
    first[starts] = True
    cut = np.zeros(n, bool)  # a separator inside a token
    cut[:-1] = sep[:-1] & ~first[:-1] & (letter[1:] | mark[1:])
    letters, marks = inside(letter), inside(mark)
    noisy = ((letters > 0) & ((marks > 0) | (inside(same) > 0) | (inside(cut) > 0))) | (marks >= 3)
    row = np.searchsorted(bounds, np.arange(len(starts)), side="right") - 1
    data = part.tobytes()
    out: list[tuple[int, str, list[str]]] = [(int(row[t]), data[starts[t] : ends[t]].decode("utf-8", "ignore"), []) for t in np.flatnonzero(noisy).tolist()]
    chars = inside((part & 0xC0) != 0x80)
    plain = letters + marks

    def neighbours(short: np.ndarray, least: int) -> list[tuple[int, int]]:
        joint = short & np.concatenate([[False], short[:-1] & (row[1:] == row[:-1])])
        a = np.flatnonzero(short & ~joint)
        b = np.flatnonzero(short & ~np.concatenate([joint[1:], [False]])) + 1
        long = b - a >= least
        return list(zip(a[long].tolist(), b[long].tolist()))

    def joined(a: int, b: int) -> str:
        return b" ".join([data[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]).decode("utf-8", "ignore")

    single, at = neighbours((chars == 1) & (plain > 0), 3), 0
    for a, b in neighbours((chars <= PIECE) & (plain > 0), 2):
        inner = []
        while at < len(single) and single[at][1] <= b:
            inner += [joined(*single[at])] if single[at] != (a, b) else []
            at += 1
        out.append((int(row[a]), joined(a, b), inner))
    return out


def _features(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, names): the whole words, then each length of beginning of the words that are longer."""
    p = K.prefix(part)
    size = ends - starts
    at = np.flatnonzero(size >= 3)
    yield at, K.name(p, starts[at], ends[at]) ^ np.uint64(0x5851F42D4C957F2D)
    for k in STARTS:
        at = np.flatnonzero(size > k)
        yield at, K.name(p, starts[at], starts[at] + k)


def _words(part: np.ndarray, off: np.ndarray, decode: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Plain and restored words: their bytes, starts, ends and rows, and how many are plain."""
    starts, ends, bounds = K.spans(part, off, K.WORD)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    again: list[tuple[int, bytes]] = []
    for row, token, runs in noisy_tokens(part, off):
        words = decode.restored(token)
        for run in runs:
            words = words + [w for w in decode.restored(run) if w not in words]
        if words:
            again += [(row, w) for w in words]
    if not again:
        return part, starts, ends, rows, len(rows)
    more = np.frombuffer(b" ".join(w for _, w in again), np.uint8)
    e = np.cumsum([len(w) + 1 for _, w in again]) - 1 + len(part)
    s = np.concatenate([[len(part)], e[:-1] + 1])
    return np.concatenate([part, more]), np.concatenate([starts, s]), np.concatenate([ends, e]), np.concatenate([rows, np.array([r for r, _ in again])]), len(rows)


@dataclass
class Model:
    """names (sorted) and weights of features; coef of the document model; the character model."""

    characters: np.ndarray
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    coef: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))

    def evidence(self, part: np.ndarray, off: np.ndarray, decode: Decoder) -> tuple[np.ndarray, ...]:
        """Per row: summed word weights, scored words, scored words that were restored, words."""
        n = len(off) - 1
        text, starts, ends, rows, plain = _words(part, off, decode)
        words = np.bincount(rows, minlength=n)
        top = np.zeros(len(starts))
        if len(self.names):
            sieve = np.zeros(1 << 20, bool)
            sieve[(self.names >> np.uint64(44)).astype(np.int64)] = True
            for at, names in _features(text, starts, ends):
                may = np.flatnonzero(sieve[(names >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.names, names[may]), len(self.names) - 1)
                hit = self.names[place] == names[may]
                w = at[may[hit]]
                top[w] = np.maximum(top[w], self.weights[place[hit]])
        hits = top > 0
        restored = hits & (np.arange(len(starts)) >= plain)
        return np.bincount(rows, top, minlength=n).astype(float), np.bincount(rows[hits], minlength=n), np.bincount(rows[restored], minlength=n), words

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.coef[0] + self.coef[1] * np.log1p(total) + self.coef[2] * np.log1p(100 * total / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _feature_counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value.characters)
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            buf, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets, 1 << 20):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                text, starts, ends, rows, _ = _words(part, off, decode)
                for at, names in _features(text, starts, ends):
                    order = np.lexsort((names, rows[at]))
                    r, f = rows[at][order], names[order]
                    once = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])]) if len(r) else np.zeros(0, bool)
                    f, back = np.unique(f[once], return_inverse=True)
                    t = np.bincount(back, toxic[i:j][r[once]], minlength=len(f)).astype(np.int64)
                    n = np.bincount(back, minlength=len(f))
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(t), pa.array(n - t)], names=["name", "toxic", "clean"])

    return run


def _training_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value.characters)
        for batch in batches:
            buf, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                total, _, _, words = model.value.evidence(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], decode)
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), batch.column(1).slice(i, j - i)], names=["total", "words", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> Model:
    """The character model of all documents, and word weights and document model of labelled ones.

    At most `train_toxic` and `train_clean` labelled documents are fitted on, in the order of a hash of their id; the
    document model gives back the classes' shares among all labels. Null labels, ids and texts don't count, a
    document labelled twice counts as toxic if one label says so. Without labels of both classes no text is toxic.
    """
    spark = docs.sparkSession
    lower = docs.select(F.lower(F.col(text_col)).alias("text"))
    rows = lower.mapInArrow(trigram_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    model = Model(log_model(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id_")).agg(F.max(label_col).cast("long").alias("toxic"))
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return model
    by = F.xxhash64("id_", F.lit("train"))
    chosen = known.where("toxic = 1").orderBy(by).limit(train_toxic).union(known.where("toxic = 0").orderBy(by).limit(train_clean))
    train = docs.select(F.col(id_col).cast("long").alias("id_"), F.lower(F.col(text_col)).alias("text")).where("text is not null").join(F.broadcast(chosen), "id_").select("text", "toxic")  # bounded
    held = spark.sparkContext.broadcast(model)
    counts = train.mapInArrow(_feature_counts(held), "name long, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_DOCS)
    n_t, n_c = (min(share[1], train_toxic), min(share[0], train_clean))
    odds = F.log((F.col("t") + 0.5) / (F.lit(n_t + 0.5) - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(n_c + 0.5) - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = counts.withColumn("w", odds).withColumn("z", F.col("w") / error).where((F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= 3)).select("name", "w").collect()  # the labelled sample bounds them
    kept.sort(key=lambda r: r["name"] % 2**64)
    model.names = np.array([r["name"] for r in kept], np.int64).view(np.uint64)
    model.weights = np.array([r["w"] for r in kept], float)
    held = spark.sparkContext.broadcast(model)
    fitted = train.mapInArrow(_training_rows(held), "total double, words long, toxic long").collect()
    if len({r[2] for r in fitted}) < 2:
        return model
    total, words, y = (np.array([r[k] for r in fitted], float) for k in range(3))
    x = np.stack([np.ones(len(y)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], 1)
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    model.coef = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def _scored(model, text_at: int):
    """Adds score, scored words and restored words to the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        decode = Decoder(m.characters)
        for batch in batches:
            buf, offsets = K.text_bytes(batch.column(text_at))
            found = []
            for i, j in K.slices(offsets):
                total, hits, restored, words = m.evidence(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], decode)
                found.append((m.probability(total, words), hits, restored))
            score, hits, restored = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            extra = [pa.array(score), pa.array(hits.astype(np.int64)), pa.array(restored.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], "score_", "hits_", "restored_"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with score_ (probability of being toxic), hits_ (words with evidence) and restored_ (those of
    them that decoding restored). A null or empty text has no words and the score of a text without evidence; repeated
    rows get the same score each; an empty table gives an empty one. Columns of `docs` of these names are replaced."""
    docs = docs.drop("score_", "hits_", "restored_")
    held = docs.sparkSession.sparkContext.broadcast(model)
    lower = docs.withColumn(fresh(docs, "lower_"), F.lower(F.col(text_col)))
    return lower.mapInArrow(_scored(held, len(docs.columns)), fields(docs, "score_ double, hits_ long, restored_ long"))


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """(doc_id, score, hits, restored) of the documents that are toxic; doc_id is the number of common.node.

    Every row is judged by its own text alone: repeated rows are returned each, rows of one id and several texts each
    by theirs. Null, empty and blank texts hold no evidence and aren't toxic, unless the labels say that texts
    without evidence mostly are. Without labels of both classes nothing is toxic; empty tables give an empty one.
    """
    own = docs.select(node(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(own, fit(docs, labels, id_col, text_col, **settings))
    return scored.where(F.col("score_") >= threshold).select("doc_id", F.round("score_", 6).alias("score"), F.col("hits_").alias("hits"), F.col("restored_").alias("restored"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The documents without those that `toxic_documents` finds; all columns, rows with null and empty texts and
    repeated rows stay as they are, whatever the columns are called. An empty table gives an empty one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    model = fit(docs, labels, id_col, text_col, **settings)
    scored = score(docs.toDF(*names), model, names[docs.columns.index(text_col)])
    return scored.where(F.col("score_") < threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
