"""Repeated passages by bucket-pointer refinement of a sparse suffix order (after Schürmann and Stoye, 2007).

Suffixes start at words. Initial buckets hold equal q-grams; a bucket of h words is refined to one of 2h by sorting on
the bucket identifiers at the suffix and at its later offset h, and the refined identifiers are the pointers of the
next round: 7, 14 and 28 words, then 50. Suffixes that are alone in their bucket leave.

Two facts keep the rounds small. Every passage of `words` words contains the smallest q-gram of its windows, so the
rounds sort only such anchors (about 2 in words - q + 2 positions), and half of the rest of a passage lies on one side
of its anchor: an anchor stays as long as the bucket of the suffix that begins with it, or of the one that ends with
it, holds another document. The last round sorts the suffixes that an anchor which stayed admits. And identifiers are
64-bit names made of the pair itself, so a pointer needs no lookup in another partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.llm import kernel as K
from textguard.llm.common import node

#: Passages of 50 words; initial buckets of 7 words.
WORDS, Q = 50, 7


def _steps(words: int, q: int) -> list[tuple[int, int]]:
    """(h, offset) of each refinement: from buckets of h words to buckets of h + offset. All but the last double, as far
    as the longer side of an anchor surely reaches."""
    out, h = [], q
    while 2 * h <= q + -(-(words - q) // 2):
        out.append((h, h))
        h *= 2
    return [*out, (h, words - h)]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return K.mix(left * np.uint64(0x9E3779B97F4A7C15) ^ K.mix(right + np.uint64(0x632BE59BD9B4E019)))


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, len(x) - w + 1 results."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def _identifiers(words: np.ndarray, bounds: np.ndarray, q: int, steps: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """(h, identifier of the h words from each word) of every bucket size; near a row's end they mean nothing."""
    grams, at, _ = K.grams(words, bounds, q, short=False)
    ids = np.zeros(len(words), np.uint64)
    ids[at] = grams
    out = [(q, ids)]
    for h, _ in steps[:-1]:
        ids = _pair(ids, np.concatenate([ids[h:], np.zeros(min(h, len(ids)), np.uint64)]))
        out.append((2 * h, ids))
    return out


def _anchors(words: int, q: int):
    """The smallest q-grams of the windows: identifier, document, place, and the identifiers that each refinement looks up
    after (r) and before (l) them; null where the text ends."""
    wide, steps = words - q + 1, _steps(words, q)
    levels = range(1, len(steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            buf, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = K.spans(part, off, K.NONSPACE)
                if len(starts) < words:
                    continue
                named = K.name(K.prefix(part), starts, ends)
                names, at, first = K.grams(named, bounds, q, short=False)
                if len(names) < wide:
                    continue
                row = np.repeat(np.arange(j - i), np.diff(first))
                low = _slide(names, wide, np.minimum)
                low[row[: len(low)] != row[wide - 1 :]] = 0  # windows over two documents
                edge = np.zeros(wide - 1, np.uint64)
                chosen = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), wide, np.maximum) == names) & (names != 0))
                r, p = row[chosen], at[chosen]
                later, before = [], []
                for (h, ids), _ in zip(_identifiers(named, bounds, q, steps), levels):
                    for to, off_, ok in ((later, p + h, p + 2 * h <= bounds[r + 1]), (before, p + q - 2 * h, p + q - 2 * h >= bounds[r])):
                        to.append(pa.array(ids[np.clip(off_, 0, len(ids) - 1)].view(np.int64), mask=~ok))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[chosen].view(np.int64)), pa.array(nodes[i:j][r]), pa.array((p - bounds[r]).astype(np.int32)), *later, *before],
                    names=["name", "node", "at", *(f"r{k}" for k in levels), *(f"l{k}" for k in levels)],
                )

    return run


def _last_round(words: int, q: int):
    """From documents with the anchors that stayed: the names of the last refinement at every suffix they admit."""
    steps = _steps(words, q)
    h, reach = steps[-1][0], words - q
    pointers = [*range(h, words - h, h), words - h]  # offsets at which the buckets of h words cover a passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            buf, offsets = K.text_bytes(batch.column(1))
            lists = batch.column(2)
            anchor_at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, j in K.slices(offsets):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = K.spans(part, off, K.NONSPACE)
                ids = _identifiers(K.name(K.prefix(part), starts, ends), bounds, q, steps)[-1][1]
                mine = values[anchor_at[i] : anchor_at[j]]
                r = np.repeat(np.arange(j - i), np.diff(anchor_at[i : j + 1]))
                # starts of passages that hold an anchor: marks of +1 and -1 along the words
                lens = np.diff(bounds)
                lo, hi = np.maximum(mine - reach, 0), np.minimum(mine, lens[r] - words)
                ok = lo <= hi
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, bounds[r[ok]] + lo[ok], 1)
                np.add.at(mark, bounds[r[ok]] + hi[ok] + 1, -1)
                want = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                row = np.searchsorted(bounds, want, side="right") - 1
                name = ids[want]
                for p in pointers:
                    name = _pair(name, ids[want + p])
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(nodes[i:j][row]), pa.array((want - bounds[row]).astype(np.int32))], names=["name", "node", "at"])

    return run


def _islands(words: int):
    """From (node, at, original) in order: runs of words that repeated passages cover."""

    def close(n: np.ndarray, a: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (a[1:] > a[:-1] + words)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(n)]]) - 1
        # words that a passage covers which isn't the original
        m, c = n[~o], a[~o]
        grown = np.minimum(np.concatenate([np.where(m[1:] == m[:-1], c[1:] - c[:-1], words), [words]]), words) if len(m) else np.zeros(0, np.int64)
        per = np.zeros(len(first), np.int64)
        np.add.at(per, (np.cumsum(new) - 1)[~o], grown)
        return pa.RecordBatch.from_arrays(
            [pa.array(n[first]), pa.array(a[first].astype(np.int64)), pa.array(a[last].astype(np.int64) + words), pa.array(per)], names=["doc_id", "start_word", "end_word", "repeated_words"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if last:
                yield close(*(np.concatenate([*(h[k] for h in held), c[:last]]) for k, c in enumerate(cols)))
                held = []
            held.append(tuple(c[last:].copy() for c in cols))
        if held:
            yield close(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return run


def _shared(names: DataFrame) -> DataFrame:
    """The suffixes whose bucket holds suffixes of two documents; `original`: those of its smallest key."""
    by = Window.partitionBy("name")
    both = names.withColumn("low", F.min("node").over(by)).withColumn("high", F.max("node").over(by))
    return both.where("low <> high").withColumn("original", F.col("node") == F.col("low")).drop("low", "high")


def _refined(anchors: DataFrame, rounds: int) -> DataFrame:
    """The anchors that stay. Partitioned once, by the initial bucket; each round sorts what is left of every bucket on the
    identifiers at the next offset, after the anchor and before it."""
    out = _shared(anchors).drop("original").withColumn("right", F.lit(True)).withColumn("left", F.lit(True))
    for k in range(1, rounds + 1):
        for side, c in (("right", "r"), ("left", "l")):
            by = Window.partitionBy("name", *(f"{c}{x}" for x in range(1, k + 1)))
            met = F.col(f"{c}{k}").isNotNull() & (F.min("node").over(by) != F.max("node").over(by))
            out = out.withColumn(side, F.col(side) & met)
        out = out.where("right or left")
    return out.select("node", "at")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, q: int = Q) -> DataFrame:
    """(doc_id, start_word, end_word, repeated_words): the runs of words covered by passages of `words` words that
    occur, word for word, in another document.

    Words are runs of non-space characters (ASCII spaces); white space may differ. Runs are maximal and in words
    counted from 0, the end exclusive; repeated_words counts those a passage covers whose first occurrence (the
    smallest document) is elsewhere, which are the ones to remove. doc_id is the key of textguard.llm.common.node.

    A text that is null, empty or shorter than `words` words has none; repeated rows are one document and don't
    repeat each other; an empty table gives an empty one; other columns aren't read. Passages are compared by 64-bit
    names: among n windows two different ones share a name with probability of about n * n / 2^65. Needs q < words.
    """
    if not 1 <= q < words:
        raise ValueError("1 <= q < words is needed")
    keyed = docs.select(node(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    rounds = len(_steps(words, q)) - 1
    pointers = "".join(f", {c}{k} long" for c in "rl" for k in range(1, rounds + 1))
    found = _refined(keyed.mapInArrow(_anchors(words, q), "name long, node long, at int" + pointers), rounds)
    anchors = found.groupBy("node").agg(F.sort_array(F.collect_set("at")).alias("anchors"))
    level = _shared(keyed.join(anchors, "node").select("node", "text", "anchors").mapInArrow(_last_round(words, q), "name long, node long, at int"))
    one = level.select("node", "at", "original")
    return one.repartition("node").sortWithinPartitions("node", "at").mapInArrow(_islands(words), "doc_id long, start_word long, end_word long, repeated_words long")
