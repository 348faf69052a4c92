"""Candidate buckets: verified links inside each bucket, then distributed union-find.

A bucket of any size is worked off exactly: a breadth-first search compares each reached member only with those
not reached yet, so a bucket of near-identical members costs one pass, and no pair is skipped. A bucket of more than
HOT members is cut into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import KEY, components, drop, written

#: Members of a bucket that one task compares; larger ones are cut into chunks of this size.
HOT = 8192
NODE = np.dtype([("id", "<i8"), ("own", "<i8")])

#: (sketch of one member, sketches of others) -> similarities
Similarity = Callable[[np.ndarray, np.ndarray], np.ndarray]


def nodes_of(column: pa.Array) -> np.ndarray:
    """Keys of documents as a structured array."""
    out = np.empty(len(column), NODE)
    out["id"], out["own"] = (c.to_numpy() for c in column.flatten())
    return out


def nodes_to(nodes: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(nodes[c])) for c in NODE.names], names=list(NODE.names))


def odd_similarity(samples: int, bits: int) -> Similarity:
    """Jaccard similarity from the XOR of two odd sketches of `samples` minimum hashes."""
    table = np.arange(bits + 1) / bits
    with np.errstate(divide="ignore"):
        apart = np.log(np.maximum(1 - 2 * table, 1e-9)) / np.log(1 - 2 / bits)  # elements in one set alone, of 2 * samples
    table = 1 - apart / (2 * samples)

    def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        x = np.bitwise_xor(others.view(np.uint64), one.view(np.uint64))
        return table[np.bitwise_count(x).sum(axis=-1)]

    return similarity


def match_similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of equal 8-bit minimum hashes, without the part that is equal by chance."""
    return ((others == one).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (n, bits / 8): each sample flips the bit that its position and value choose."""
    n, k = signature.shape
    at = signature.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = ((at ^ (at >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)
    flat = (at % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    odd = (np.bincount(flat.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1)


def _forest(nodes: np.ndarray, sketches: np.ndarray, similarity: Similarity, least: float) -> list[np.ndarray]:
    """Links (member, smallest member) of the components of one bucket."""
    out: list[np.ndarray] = []
    left = np.arange(len(nodes))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        group = []
        while reached and len(left):
            at = reached.pop()
            group.append(at)
            near = similarity(sketches[at], sketches[left]) >= least
            reached.extend(left[near].tolist())
            left = left[~near]
        group += reached
        if len(group) > 1:
            ids = np.unique(nodes[group])
            out.append(np.stack([ids[1:], np.repeat(ids[:1], len(ids) - 1)], 1))
    return out


def _links(similarity: Similarity, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def close(keys: np.ndarray, nodes: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(keys)]]))
        two = first[sizes == 2]
        near = similarity(sk[two], sk[two + 1]) >= least if len(two) else np.zeros(0, bool)
        more = [e for i, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()) for e in _forest(nodes[i : i + n], sk[i : i + n], similarity, least)]
        both = np.concatenate([np.stack([nodes[two[near]], nodes[two[near] + 1]], 1), *more])
        return pa.RecordBatch.from_arrays([nodes_to(both[:, 0]), nodes_to(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), nodes_of(batch.column(1))
            data = batch.column(2)
            buf, off = np.frombuffer(data.buffers()[2], np.uint8), np.frombuffer(data.buffers()[1], np.int32)[data.offset :]
            width = int(off[1] - off[0])
            sk = buf[off[0] : off[0] + width * batch.num_rows].reshape(-1, width)
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # sorted: the last bucket may go on
            if not last:
                held.append((keys.copy(), nodes.copy(), sk.copy()))
                continue
            yield close(*(np.concatenate([*(h[i] for h in held), x[:last]]) for i, x in enumerate((keys, nodes, sk))))
            held = [(keys[last:].copy(), nodes[last:].copy(), sk[last:].copy())]
        if held:
            yield close(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return run


def tiled(rows: DataFrame, sizes: DataFrame, member: str, hot: int) -> DataFrame:
    """`rows` (bucket, member, ...) with each bucket that `sizes` (bucket, n) counts at more than `hot` members cut into
    n / hot chunks, one new bucket for every two of them; each member goes to as many as there are chunks."""
    large = written(sizes.where(F.col("n") > hot).select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("chunks_")), "hot")  # written: its size decides how it is joined
    own = F.pmod(F.xxhash64(member), F.col("chunks_")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks_") - 1), lambda i: F.xxhash64("bucket", F.least(own, i), F.greatest(own, i)))
    cut = F.when(F.col("chunks_").isNull(), F.array("bucket")).otherwise(pairs)
    return rows.join(large, "bucket", "left").withColumn("tile_", F.explode(cut)).withColumn("bucket", F.col("tile_")).drop("tile_", "chunks_")


def linked(table: DataFrame, similarity: Similarity, least: float, hot: int = HOT) -> DataFrame:
    """(node, comp) of all nodes that are alike another, linked directly or through others.

    `table`, a written one: node (common.KEY), same BIGINT, bands ARRAY<BIGINT>, sketch BINARY (all of one width).
    Nodes of equal `same` and sketch have equal content and are linked to the smallest of them, which alone goes into
    the buckets.
    """
    one = written(table.groupBy("same", "sketch").agg(F.min(F.struct("node", "bands")).alias("x")).select("same", "sketch", "x.node", "x.bands"), "distinct")
    copies = table.join(one.select("same", "sketch", F.col("node").alias("rep")), ["same", "sketch"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    rows = one.select(F.explode("bands").alias("bucket"), "node", "sketch")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    links = tiled(rows, sizes, "node", hot).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(similarity, least), f"a {KEY}, b {KEY}")
    out = components(links.union(copies))
    drop(one)
    return out
