"""Byte-pair encoding with a distinct-word table, and decoding by an id-to-piece join.

Spark splits the texts into words. Each group of documents keeps its distinct words once and its texts as positions
in that list. The word lists travel, cut by a hash of the word, so that every distinct word of all documents meets in
one place and is encoded once; the ids go back to their group and are joined to the texts by position. Lists travel as
compressed blocks, so a group sends a few rows and not one per word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm import kernel as K
from textguard.llm.common import node

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a group of documents, and for each part that the distinct words are cut into: there are as many
#: parts as the input needs, so that a part's size doesn't grow with it.
GROUP_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Bytes from which a word is merged by a heap.
LONG = 64

_CODEC = pa.Codec("zstd", 3)


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The pieces of a rank file and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Ids of one word: merges the pair of lowest rank, the leftmost of equal ones, until none is left."""

    def __init__(self, pieces: dict[bytes, int]):
        self.pieces = pieces

    def __call__(self, word: bytes) -> list[int]:
        pieces = self.pieces
        if (whole := pieces.get(word)) is not None:
            return [whole]
        if len(word) >= LONG:
            return self._long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        none = len(pieces) + 1
        pair = [pieces.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = pieces.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = pieces.get(parts[i - 1] + parts[i], none)
        return [pieces[p] for p in parts]

    def _long(self, word: bytes) -> list[int]:
        """The same merges in n log n steps: pieces are a linked list by their first byte, pairs lie in a heap, and an
        entry whose pieces have changed since is passed over."""
        rank, n = self.pieces.get, len(word)
        size, before = [1] * n + [0], [*range(-1, n - 1), n - 1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = i + size[i]
            if not size[i] or j >= n or size[i] + size[j] != both:
                continue
            size[i], size[j] = both, 0
            after = i + both
            before[after] = i
            if after < n and (r := rank(word[i : after + size[after]])) is not None:
                heapq.heappush(heap, (r, i, both + size[after]))
            p = before[i]
            if p >= 0 and (r := rank(word[p:after])) is not None:
                heapq.heappush(heap, (r, p, after - p))
        out, i = [], 0
        while i < n:
            out.append(self.pieces[word[i : i + size[i]]])
            i += size[i]
        return out


def _pack(x: np.ndarray | bytes) -> bytes:
    """The bytes, compressed, after their length."""
    data = x if isinstance(x, bytes) else x.tobytes()
    return len(data).to_bytes(8, "little") + (_CODEC.compress(data, asbytes=True) if data else b"")


def _unpack(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], n, asbytes=True) if n else b""


def _varints(x: np.ndarray) -> bytes:
    """Small numbers in few bytes: low 7 bits first."""
    x = x.astype(np.uint32)
    out = np.zeros((len(x), 5), np.uint8)
    size = np.ones(len(x), np.int64)
    for k in range(5):
        out[:, k] = (x >> np.uint32(7 * k)) & np.uint32(127)
        size[(x >> np.uint32(7 * k)) > 0] = k + 1
    inner = np.arange(5) < size[:, None]
    out[np.arange(5) < (size - 1)[:, None]] |= 128
    return out[inner].tobytes()


def _unvarints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int32)
    last = b < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.concatenate([first, [len(b)]])))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first).astype(np.int32)


def _grouped(parts: int, limit: int):
    """Per group of documents one row of texts, as positions in the group's word list, and one row of words for every
    part that has some; `key` is the group or the part."""
    schema = pa.schema([("key", pa.string()), ("grp", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])

    def emit(stem: str, held: list[tuple]) -> pa.RecordBatch:
        words = pa.chunked_array([w for _, _, w, _ in held]).combine_chunks().dictionary_encode()
        at, distinct = words.indices.to_numpy(), words.dictionary
        order = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")  # frequent words get small positions
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        distinct = distinct.take(pa.array(order))
        ids, hashes, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
        grp = f"{stem}-{int(np.bitwise_xor.reduce(hashes ^ ids)) & 0xFFFFFFFF:x}"
        rows = [("g" + grp, grp, 0, _blocks(_pack(ids), _pack(hashes), _pack(_varints(sizes)), _pack(_varints(rank[at]))))]
        buf, off = K.text_bytes(distinct)
        names = K.name(K.prefix(buf), off[:-1], off[1:]) if len(distinct) else np.zeros(0, np.uint64)
        part = (names % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by_part], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            mine = by_part[cut[k] : cut[k + 1]]
            b, o = K.text_bytes(distinct.take(pa.array(mine)))
            rows.append((f"p{k}", grp, 1, _blocks(_pack(_varints(np.diff(o))), _pack(_varints(np.diff(mine, prepend=0))), _pack(b[o[0] : o[-1]].tobytes()))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem, n = f"{task.partitionId() if task else 0}", 0
        held, size = [], 0
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            off = off - off[0]
            values = lists.flatten()
            own = K.text_bytes(values)[1]
            per = own[off] - own[0]
            for i, j in K.slices(per, limit):
                held.append((batch.column(0).slice(i, j - i).to_numpy(), batch.column(1).slice(i, j - i).to_numpy(), values.slice(off[i], off[j] - off[i]), np.diff(off[i : j + 1])))
                size += int(per[j] - per[i])
                if size >= limit // 2:
                    yield emit(f"{stem}-{n}", held)
                    held, size, n = [], 0, n + 1
        if held:
            yield emit(f"{stem}-{n}", held)

    return run


def _blocks(*blocks: bytes) -> bytes:
    return np.array([len(b) for b in blocks], np.int32).tobytes() + b"".join(blocks)


def _unblocked(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(data[: 4 * n], np.int32)) + 4 * n
    return [_unpack(data[a:b]) for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _encoded(path: str):
    """From the rows of words, in order of their parts: each distinct word of a part is encoded once, and every
    group's list gets its ids. A part comes to one task, so this is once for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks(path))
        known: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            for key, grp, kind, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not kind:
                    continue
                if key != last:
                    known, last = {}, key
                sizes, at, text = _unblocked(data, 3)
                ends = np.cumsum(_unvarints(sizes)).tolist()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends):
                    w = text[a:b]
                    if (k := known.get(w)) is None:
                        k = known[w] = np.array(encode(w), np.int32).tobytes()
                    ids.append(k)
                counts = np.array([len(k) // 4 for k in ids])
                flat = np.frombuffer(b"".join(ids), np.int32)
                out = _blocks(_pack(at), _pack(_varints(counts)), _pack(_varints(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(["g" + grp]), pa.array([out], pa.binary())], names=["key", "data"])

    return run


def _joined(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Joins the ids of a group's words to its documents by position."""
    z = np.zeros(0, np.int32)
    places, counts, ids = [], [], []
    for data in words.column("data").to_pylist():
        p, c, i = _unblocked(data, 3)
        places.append(np.cumsum(_unvarints(p)))
        counts.append(_unvarints(c))
        ids.append(_unvarints(i))
    place, count, flat = (np.concatenate(x) if x else z for x in (places, counts, ids))
    size, start = np.zeros(len(place), np.int32), np.zeros(len(place), np.int64)
    size[place], start[place] = count, np.cumsum(count) - count
    out = []
    for kind, data in zip(docs.column("kind").to_pylist(), docs.column("data").to_pylist()):
        if kind:
            continue
        doc_ids, hashes, sizes, codes = _unblocked(data, 4)
        codes = _unvarints(codes)
        if len(codes) and int(codes.max()) >= len(place):
            raise ValueError("a group's words are missing: its input was not the same when it was computed again")
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[codes] - (ends - n), n)
        firsts = np.concatenate([[0], np.cumsum(_unvarints(sizes))])
        offsets = np.concatenate([[0], ends])[firsts].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at], pa.int32()))
        out.append(pa.table({"doc_id": np.frombuffer(doc_ids, np.int64), "hash": np.frombuffer(hashes, np.int64), "n_tokens": np.diff(offsets).astype(np.int64), "ids": lists}))
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, hash, n_tokens, ids): the token ids of every document, and the xxhash64 of its text.

    Special tokens in a text are ordinary text. A null text counts as empty and has no tokens; repeated rows each
    give a row; doc_id is the key of textguard.llm.common.node; an empty table gives an empty one; other columns
    aren't read. `vocabulary` is a rank file that every executor can open. The ids don't depend on the sizes of groups
    and parts.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(node(id_col, text_col).alias("doc_id"), F.xxhash64(text).alias("hash"), F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)).alias("words"))
    # both sides read one exchange by `key`, so the texts are split and grouped once
    rows = split.mapInArrow(_grouped(parts, group_bytes), "key string, grp string, kind int, data binary").repartition(parts, "key")
    words = rows.sortWithinPartitions("key").mapInArrow(_encoded(vocabulary), "key string, data binary")
    return rows.groupBy("key").cogroup(words.groupBy("key")).applyInArrow(_joined, "doc_id long, hash long, n_tokens long, ids array<int>")


def _decoded(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        pieces: list[bytes | None] = [None] * (max(table.values(), default=-1) + 1)
        for piece, i in table.items():
            pieces[i] = piece
        by_id = pa.array(pieces, pa.large_binary())
        for batch in batches:
            lists = batch.column(at)
            ids = lists.flatten()
            off = lists.offsets.to_numpy().astype(np.int64)
            joined = by_id.take(ids)  # the join of ids with pieces
            if joined.null_count:
                raise ValueError("an id has no piece")
            buf, o = K.text_bytes(joined)
            ends = o[off - off[0]]
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)]).cast(pa.binary())
            keep = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*keep, data], names=[*(x for k, x in enumerate(batch.schema.names) if k != at), "bytes_"])

    return run


def decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids in `text_col` in place of the ids. No ids, or null, give an empty text; an
    id without a piece is an error; bytes that aren't UTF-8 are replaced."""
    at = tokens.columns.index(ids_col)
    rest = [f for f in tokens.schema.fields if f.name != ids_col]
    schema = T.StructType(rest).add("bytes_", "binary")
    filled = tokens.withColumn(ids_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")))
    out = filled.mapInArrow(_decoded(vocabulary, at), schema)
    return out.withColumn(text_col, F.expr("make_valid_utf8(cast(bytes_ as string))")).drop("bytes_")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, n_tokens, ids, same): the ids, and whether decoding gives the text back."""
    tokens = encode(docs, id_col, text_col, **settings)
    vocabulary = settings.get("vocabulary", VOCABULARY)
    back = decode(tokens.withColumn("own", F.col("ids")), "own", vocabulary)
    return back.select("doc_id", "n_tokens", "ids", (F.xxhash64("text") == F.col("hash")).alias("same"))
