"""Fuzzy line deduplication: character-shingle MinHash, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm import kernel as K
from textguard.llm.buckets import tiled
from textguard.llm.common import components, drop, fresh, node, written

#: Shingles of 8 bytes, 6 bands of 4 minimum hashes, lines alike from a Jaccard similarity of 0.8.
SHINGLE, BANDS, ROWS, LEAST = 8, 6, 4, 0.8
#: Lines of a bucket that one task compares; larger ones are cut into chunks of this size.
HOT = 2048
#: The sieve of candidate names has 2^SIEVE bits (16 MB), whatever the input. It lets some other lines through, more
#: of them the more candidates there are; the join by name drops those.
SIEVE = 27

_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _normal(text: str | Column) -> Column:
    """Lower case; blanks at a line's ends are left to the kernel."""
    return F.lower(F.col(text) if isinstance(text, str) else text)


def _lines(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with other than white space: starts, ends (trimmed), rows, line numbers, names."""
    starts, ends, bounds = K.spans(part, off, _NEWLINE)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    breaks = np.concatenate([[0], np.cumsum(part == 10)])
    number = breaks[starts] - breaks[off[rows]]
    inner = np.concatenate([[0], np.cumsum(K.NONSPACE[part])])
    full = inner[ends] > inner[starts]
    starts, ends, rows, number = starts[full], ends[full], rows[full], number[full]
    solid = np.flatnonzero(K.NONSPACE[part])
    starts, ends = solid[inner[starts]], solid[inner[ends] - 1] + 1  # trimmed
    return starts, ends, rows, number, K.name(K.prefix(part), starts, ends)


def _shingles(part: np.ndarray, size: int) -> np.ndarray:
    """The `size` (1 to 8) bytes at every offset, as one number each."""
    if len(part) < 8:
        part = np.concatenate([part, np.zeros(8 - len(part), np.uint8)])
    own = np.ndarray((len(part) - 7,), np.dtype("<u8"), np.ascontiguousarray(part), strides=(1,)).copy()
    if size < 8:
        tail = np.concatenate([part[-7:], np.zeros(7, np.uint8)])
        own = np.concatenate([own, np.ndarray((7,), np.dtype("<u8"), tail, strides=(1,))]) & np.uint64((1 << 8 * size) - 1)
    return own


def _minhash(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, k: int) -> np.ndarray:
    """k minimum hashes of the shingles of each line; the lines are in order and longer than `size`."""
    if not len(starts):
        return np.empty((0, k), np.uint32)
    x = _shingles(part, size)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    low = (x >> np.uint64(32)).astype(np.uint32)
    edges = np.stack([starts, ends - size + 1], 1).ravel()
    edges = edges[:-1] if edges[-1] >= len(low) else edges
    out, g = np.empty((len(starts), k), np.uint32), np.empty_like(low)
    for j in range(k):
        np.multiply(low, K._MUL[j], out=g)
        g += K._ADD[j]
        out[:, j] = np.minimum.reduceat(g, edges)[::2]
    return out


def _parts(texts: pa.Array, limit: int = K.CHUNK):
    buf, offsets = K.text_bytes(texts)
    for i, j in K.slices(offsets, limit):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, part, _lines(part, off)


def _signed(size: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, (starts, ends, _, _, names) in _parts(batch.column(0), 1 << 18):  # the arrays of a pass stay in cache
                once = np.sort(np.unique(names, return_index=True)[1])
                once = once[ends[once] - starts[once] > size]  # a line of one shingle is like equal lines alone
                keys = K.bands(_minhash(part, starts[once], ends[once], size, n_bands * rows), rows)
                yield pa.RecordBatch.from_arrays([pa.array(names[once].view(np.int64)), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(n_bands))], names=["line", *(f"b{k}" for k in range(n_bands))])

    return run


def _placed(sieve):
    """(line, node, own, at, content) of all lines, with the contents of those the sieve lets through, once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        shift = np.uint64(64 - SIEVE)
        for batch in batches:
            nodes, owns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, part, (starts, ends, rows, number, names) in _parts(batch.column(2)):
                at = (names >> shift).astype(np.int64)
                has = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                has = has[np.unique(names[has], return_index=True)[1]]
                data, content = part.tobytes(), [None] * len(names)
                for k in has.tolist():
                    content[k] = data[starts[k] : ends[k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(nodes[i + rows]), pa.array(owns[i + rows]), pa.array(number.astype(np.int32)), pa.array(content, pa.binary())], names=["line", "node", "own", "at", "content"]
                )

    return run


def _verified(size: int, least: float):
    """From (bucket, line, content) in order of buckets: links (line, smallest line) of pairs that are alike."""

    def close(keys: np.ndarray, lines: np.ndarray, contents: list[bytes]) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        sh = _shingles(np.frombuffer(b"".join(contents), np.uint8), size)
        ends = np.cumsum([len(c) for c in contents]).tolist()
        starts = [0, *ends[:-1]]
        names = lines.tolist()
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
            if j - i < 2:
                continue
            sets = [set(sh[x : y - size + 1].tolist()) for x, y in zip(starts[i:j], ends[i:j])]
            left = list(range(j - i))
            while len(left) > 1:  # as in buckets: each reached member meets only those not reached yet
                reached, left, group = [left[0]], left[1:], []
                while reached and left:
                    at = reached.pop()
                    group.append(at)
                    mine, apart = sets[at], []
                    n = len(mine)
                    for x in left:
                        m = len(sets[x])
                        if min(n, m) >= least * max(n, m) - 1e-9 and (same := len(mine & sets[x])) >= least * (n + m - same) - 1e-9:
                            reached.append(x)
                        else:
                            apart.append(x)
                    left = apart
                group += reached
                ids = sorted(names[i + x] for x in group)
                a += ids[1:]
                b += ids[:1] * (len(ids) - 1)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, contents = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n, c = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            last = int(np.searchsorted(k, k[-1], side="left"))
            if last:
                yield close(np.concatenate([keys, k[:last]]), np.concatenate([lines, n[:last]]), contents + c[:last])
                keys, lines, contents = k[last:].copy(), n[last:].copy(), c[last:]
            else:
                keys, lines, contents = np.concatenate([keys, k]), np.concatenate([lines, n]), contents + c
        if contents:
            yield close(keys, lines, contents)

    return run


def _sieve(lines: DataFrame) -> np.ndarray:
    """The bits of the names' first SIEVE bits, put together in Spark; its size is fixed."""
    at = F.shiftrightunsigned("line", 64 - SIEVE) + 1
    found = lines.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << (SIEVE - 3), np.uint8)
    for r in found:
        out[(r["k"] - 1) * 4096 :][:4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def similar_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, least: float = LEAST, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """(node, comp): names of distinct lines that are like another, with the smallest name of their component; and
    (line, node, own, at): the places of all lines, written, `own` being the hash of the document's text."""
    if not 1 <= size <= 8:
        raise ValueError("a shingle has 1 to 8 bytes")
    spark = docs.sparkSession
    texts = docs.select(node(id_col, text_col).alias("node"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own"), _normal(text_col).alias("text"))
    bands = [f"b{k}" for k in range(n_bands)]
    signed = texts.select("text").mapInArrow(_signed(size, n_bands, rows), "line long, " + ", ".join(f"{b} long" for b in bands))
    once = written(signed.groupBy("line").agg(*[F.min(b).alias(b) for b in bands]), "signed")
    banded = once.select("line", F.explode(F.array(*bands)).alias("bucket"))
    members = [F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.sum(F.xxhash64("line").bitwiseAND(F.lit(2**40 - 1))).alias("s"), F.expr("bit_xor(xxhash64(line, 7))").alias("x")]
    met = banded.groupBy("bucket").agg(*members).where("n > 1")
    met = written(met.groupBy("n", "low", "high", "s", "x").agg(F.min("bucket").alias("bucket")), "buckets")  # buckets of the same lines in several bands are one
    pairs = met.where("n = 2").select("bucket", F.explode(F.array("low", "high")).alias("line"))
    more = written(met.where("n > 2").select("bucket", "n"), "buckets")
    many = tiled(banded.join(more.select("bucket"), "bucket").select("bucket", "line"), more, "line", hot)
    candidates = written(pairs.union(many), "candidates")
    places = written(texts.mapInArrow(_placed(spark.sparkContext.broadcast(_sieve(candidates))), "line long, node long, own long, at int, content binary"), "places")
    contents = places.where("content is not null").select("line", "content").dropDuplicates(["line"])
    links = candidates.join(contents, "line").select("bucket", "line", "content").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verified(size, least), "a long, b long")
    out = components(links)
    for t in (once, met, more, candidates):
        drop(t)
    return out, places.select("line", "node", "own", "at")


def _without(text_at: int, gone_at: int):
    """Takes the lines out of the texts and the list of lines off the batch; a text that loses all drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(gone_at)
            texts: list[str | None] = batch.column(text_at).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.asarray(gone.is_valid())).tolist():
                lost = set(gone[i].as_py())
                left = [x for k, x in enumerate((texts[i] or "").split("\n")) if k not in lost]
                texts[i] = "\n".join(left)
                keep[i] = bool(texts[i].strip(" \t\r\n\v\f"))
            columns = [pa.array(texts, batch.schema.field(text_at).type) if k == text_at else c for k, c in enumerate(batch.columns) if k != gone_at]
            names = [x for k, x in enumerate(batch.schema.names) if k != gone_at]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, **settings) -> DataFrame:
    """The documents with one line of every component of alike lines.

    Lines end at \\n; they compare in lower case without blanks at their ends. Lines that are equal so, or whose sets
    of `size`-byte shingles have a Jaccard similarity of at least `least` (verified exactly; banding finds a pair
    at 0.8 with probability 0.96 and at 0.9 with 0.9999), belong to one component, directly or through others. The line of the smallest
    (document number, text hash, line number) stays, all other lines of the component go. Equal lines are found by
    64-bit names: among n distinct lines two different ones share a name with probability of about n * n / 2^65.

    A document of which no line is left goes; blank lines are neither compared nor removed. Null, empty and blank
    texts have no lines to compare: such rows stay as they are. Rows that repeat an id and text are one document:
    each of them keeps the document's lines. Rows of one id and several texts are several documents. Other columns
    stay, except `count_col`, which, if `docs` has it, gets the new length of the text. An empty table gives an empty
    one.
    """
    same, places = similar_lines(docs, id_col, text_col, **settings)
    per = places.groupBy("line").agg(F.min(F.struct("node", "own", "at")).alias("first"), F.count("*").alias("n"))
    named = per.join(same.withColumnRenamed("node", "line"), "line", "left").where("comp is not null or n > 1")
    named = written(named.select("line", F.coalesce("comp", "line").alias("comp"), "first"), "named")
    keep = named.groupBy("comp").agg(F.min("first").alias("keep"))
    lost = places.join(named.select("line", "comp").join(keep, "comp").select("line", "keep"), "line").where(F.struct("node", "own", "at") != F.col("keep"))
    id_, own, gone = fresh(docs, "_key"), fresh(docs, "_own"), fresh(docs, "_gone")
    per = lost.groupBy(F.col("node").alias(id_), F.col("own").alias(own)).agg(F.collect_list("at").alias(gone))
    marked = docs.withColumn(id_, node(id_col, text_col)).withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = marked.join(per, [id_, own], "left").select(*docs.columns, gone)
    out = joined.mapInArrow(_without(docs.columns.index(text_col), len(docs.columns)), docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out
