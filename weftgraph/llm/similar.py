"""Parts shared by the similarity joins: verified pairs and connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sessions
from weftgraph.llm.words import Scan, buffers, cells, counted, distinct, mix, slices

#: Tasks that the partners of one text are dealt to; its own text goes to each of them that has one.
SALTS = 32


def shingle_sets(column: pa.Array, width: int, weighted: bool = False) -> list[np.ndarray]:
    """The distinct shingle hashes of each text; weighted: with a value more for each time that one stands there again."""
    data, offsets = buffers(column)
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        scan = Scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        unit, value = scan.shingles(width)
        if weighted:
            unit, value, count = counted(unit, value)
            unit, value = np.repeat(unit, count), cells(value, count)
        else:
            unit, value = distinct(unit, value)
        first = np.searchsorted(unit, np.arange(b - a + 1))
        out += [value[first[i] : first[i + 1]] for i in range(b - a)]
    return out


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles of the texts, in order."""
    data, offsets = buffers(column)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in slices(offsets):
        unit, value = Scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).shingles(width)
        parts.append((a + unit, value))
    return np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts])


def parities(owner: np.ndarray, value: np.ndarray, n: int, words: int) -> np.ndarray:
    """n x words longs: for each of 64 words hash buckets, whether the owner has an odd number of values there.

    Two sets differ in at least as many values as their bits differ in places.
    """
    out = np.zeros(n * words, np.uint64)
    at = mix(value ^ np.uint64(0xE7037ED1A0B428DB))
    word = (at >> np.uint64(6)) % np.uint64(words)
    np.bitwise_xor.at(out, owner * words + word.astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64).reshape(n, words)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of distinct values."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingles have a weighted Jaccard similarity of ``least`` or more.

    texts: (node, text). Each ``a`` meets its partners in a stream of sorted rows: a
    task holds one set at a time, however many partners there are. A text with many
    partners is dealt to up to SALTS tasks with them.
    """
    salted = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")).agg(F.collect_list("b").alias("bs"))
    sides = salted.select("a", "salt", F.explode(F.concat(F.array(F.lit(None).cast("long")), "bs")).alias("b"))
    held = sides.withColumn("node", F.coalesce("b", "a")).join(texts, "node").select("a", "salt", "b", "text")
    rows = held.repartition(sessions.partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for x, y, own in zip(a, b, shingle_sets(batch.column(3), width, weighted=True)):
                if y is None:
                    head = own
                elif jaccard(head, own) >= least:
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b); root is the least node of its class. Written to the checkpoint folder.

    Contraction: every node goes to the first of itself and its neighbours in a fixed
    order of hashes, edges are renamed by that, and those inside one node go, until
    none is left. A star takes two levels, and a chain shrinks by a part of its length
    with each. Hubs are pre-aggregated before the shuffle.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left, levels = sessions.stored(edges.select("a", "b").filter("a <> b").distinct()), []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        near = ends.groupBy("x").agg(F.min(first("y")).alias("m"))
        own = sessions.stored(near.select(F.col("x").alias("node"), F.least(first("x"), F.col("m"))["id"].alias("root")))
        levels.append(own)
        a, b = own.select(F.col("node").alias("a"), F.col("root").alias("x")), own.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = left.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = sessions.stored(moved)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    top = levels[-1]
    for own in levels[-2::-1]:
        up = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
        top = own.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    low = top.groupBy("root").agg(F.min("node").alias("low"))
    out = sessions.stored(top.join(low, "root").select("node", F.col("low").alias("root")))
    sessions.drop(*levels)
    return out
