"""MinHash near-duplicates with dart signatures.

Method (DartMinHash). A text is a weighted set of word shingles, each as heavy as
it is frequent in the text. Each element is a region, as wide as its
weight, along an axis of ranks. Darts are thrown at the regions by hashes of the
elements alone: a Poisson process of ranks for each unit of width, whose last
unit accepts the darts that fall into its fraction. Only darts of ranks under
about k (ln k + 4) / total weight are made. A dart's hash picks one of k
coordinates, and each coordinate keeps its earliest dart; a text with an empty
coordinate throws again over twice the ranks. Two signatures agree in a
coordinate with the weighted Jaccard similarity as probability, and making one
costs one pass over the elements plus the darts.

Signatures are cut into bands, texts that share a band are joined, and each
joined pair is verified with exact weighted Jaccard over the texts' word shingles.
Before that a pair must pass a bound: each text has ODD longs of parity bits (the
number of its shingles in each of 64 ODD hash buckets, odd or even). Two texts'
bits differ in at most as many places as their sets have shingles that the other
lacks, so the bound loses no similar pair. The join itself applies it.

Texts with one weighted set are one node from the start (only counted). Within
the texts that share a band, all are first compared with the least node; classes
found so far are contracted, and only texts in different classes are compared
again, with the likeliest of the first LEADERS nodes, and last all that share
SHARED bands and are in different classes still. So a large group of copies costs
about its size, and no link between different texts is left out.

With 32 bands of 4 coordinates a pair at a similarity of exactly 0.8 shares no
band with probability 5e-8, and under the 2 shared bands that the last round asks
for with 1e-6.

Defined results. Null and empty texts have no shingle and are classes of their
own, one for each row. A text under five words is one shingle. The class id is
the least document id in it, null if it has none; of rows with one least id and
different texts, the first by hash of id and text stands for the class. Rows that
repeat both id and text have one result. A very long text is one set, held alone.
An empty table gives an empty result. Extra columns, whatever their names, are
ignored here and kept by ``keep_first``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sessions, similar
from weftgraph.llm.words import Scan, buffers, cells, counted, mix, slices

BANDS, ROWS = 32, 4
#: Bands that a pair must share to be verified.
SHARED = 2
WIDTH, LEAST = 5, 0.8
#: Leading nodes of a band that the second round compares with.
LEADERS = 32
#: Partners of a text, those that share most bands, that a round before the last verifies.
LIKELY = 3
#: 64-bit words of a text's parity bits.
ODD = 16
_STEP = 0x9E3779B97F4A7C15


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures (32-bit dart ids) of weighted sets given as (owner, element, weight); each owner has an element of positive weight."""
    out = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    reach = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    # Unit cells of each region; the last may be narrower.
    cells = np.ceil(weight).astype(np.int64)
    if (cells == 1).all():
        cell_owner, cell_key, room = owner, mix(element), weight
    else:
        at = np.repeat(np.arange(len(owner)), cells)
        number = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell_owner, room = owner[at], np.minimum(1.0, weight[at] - number)
        cell_key = mix(element[at] + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    todo = np.arange(n)
    while len(todo):
        mine = np.isin(cell_owner, todo) if len(todo) < n else slice(None)
        who, key, width = cell_owner[mine], cell_key[mine], room[mine]
        rank, arrival = np.zeros(len(who)), 0
        while len(who):
            arrival += 1
            dart = mix(key + np.uint64((arrival * _STEP) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank < reach[who]
            who, key, width, rank, dart = who[live], key[live], width[live], rank[live], dart[live]
            more = mix(dart ^ np.uint64(0xE7037ED1A0B428DB))
            ok = (more >> np.uint64(11)).astype(np.float64) * 2.0**-53 < width
            place = (more & np.uint64(0x7FF)).astype(np.int64) % k if k & (k - 1) == 0 and k <= 2048 else (mix(more) % np.uint64(k)).astype(np.int64)
            level = (rank / reach[who] * 2.0**32).astype(np.uint64)
            packed = np.minimum(level, np.uint64(2**32 - 1)) << np.uint64(32) | dart >> np.uint64(32)
            np.minimum.at(out.reshape(-1), (who * k + place)[ok], packed[ok])
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        out[todo] = np.iinfo(np.uint64).max
        reach[todo] *= 2
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band; keys of different bands differ."""
    n, k = signatures.shape
    value = np.zeros((n, bands), np.uint64)
    parts = signatures.reshape(n, bands, k // bands).astype(np.uint64)
    for j in range(k // bands):
        value = mix((value + parts[:, :, j]) * np.uint64(_STEP) + np.uint64(j)).reshape(n, bands)
    return mix(value + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x8EBC6AF09C88C6E3)).astype(np.int64)


def _lists(table: np.ndarray) -> pa.Array:
    """The rows of a table as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.reshape(-1)))


def _sketch(width: int, bands: int, rows: int):
    """(.., text) to (.., node, n, bands, odd): node is a hash of the shingle set, n its size, odd its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            nodes, sizes, keys, odd = [], [], [], []
            for a, b in slices(offsets):
                scan = Scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                element, value, weight = counted(*scan.shingles(width))
                unit, cell = np.repeat(element, weight), cells(value, weight)
                count = np.bincount(unit, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(count)])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(cell ^ np.uint64(0x589965CC75374CC3)))])
                nodes.append(mix(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64)).astype(np.int64))
                sizes.append(count)
                some = np.flatnonzero(count)
                small = np.searchsorted(some, element)
                table = np.zeros((b - a, bands), np.int64)
                if len(some):
                    table[some] = band_keys(dart_signatures(small, value, weight.astype(np.float64), len(some), bands * rows), bands)
                keys.append(table)
                odd.append(similar.parities(unit, cell, b - a, ODD))
            if not nodes:
                continue
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes).astype(np.int64)), _lists(np.concatenate(keys)), _lists(np.concatenate(odd))], names=["k", "id", "node", "n", "bands", "odd"])

    return run


def _key(doc_id: str, text: str):
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: k (hash of id and text), doc_id, class_id, class_size (rows in the class), n_shingles and first.

    first is true for the rows with the class's least (id, k).
    """
    spark = docs.sparkSession
    sessions.prepare(spark)
    read = docs.select(_key(doc_id, text).alias("k"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    seen = sessions.stored(read.mapInArrow(_sketch(width, bands, rows), "k bigint, id bigint, node bigint, n bigint, bands array<bigint>, odd array<bigint>"))
    least_row = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k", "n", "bands", "odd"))
    nodes = sessions.stored(seen.filter("n > 0").groupBy("node").agg(least_row.alias("x"), F.count(F.lit(1)).alias("copies")).select("node", "x.id", "x.k", "x.n", "x.bands", "x.odd", "copies"))
    odd = [f"odd{i}" for i in range(ODD)]
    places = nodes.select("node", "n", F.explode("bands").alias("key"))
    many = places.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # Most places have no partner: the parity bits are fetched for the rest only.
    bits = nodes.select("node", *[F.col("odd")[i].alias(c) for i, c in enumerate(odd)])
    members = sessions.stored(places.join(many.select("key"), "key").join(bits, "node").withColumn("root", F.col("node")))
    wanted = members.select("node").distinct().join(nodes.select("node", "k"), "node")
    texts = sessions.stored(read.select("k", "text").join(wanted, "k").groupBy("node").agg(F.min("text").alias("text")))
    links = tested = roots = None
    spent = [texts]
    for limit in (1, LEADERS, None):
        if members.isEmpty():
            break
        if limit == 1:
            leaders = members.groupBy("key").agg(F.min(F.struct("node", "n", "root", *odd)).alias("x")).select("key", "x.*")
        elif limit is None:
            leaders = members
        else:
            leaders = members.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("node"))).filter(F.col("rank") <= limit).select("key", "node", "n", "root", *odd)
        l, m = leaders.alias("l"), members.alias("m")
        alike = F.least("l.n", "m.n") >= F.lit(least) * F.greatest("l.n", "m.n")
        # Sets with a similarity of t differ in (1 - t) / (1 + t) of their sizes' sum.
        apart = reduce(operator.add, [F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"m.{c}"))) for c in odd])
        near = apart <= F.lit((1 - least) / (1 + least)) * (F.col("l.n") + F.col("m.n")) + F.lit(1e-6)
        met = m.join(l, (F.col("m.key") == F.col("l.key")) & (F.col("l.node") < F.col("m.node")) & (F.col("l.root") != F.col("m.root")) & alike & near)
        pairs = met.groupBy(F.col("l.node").alias("a"), F.col("m.node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if limit is None:
            # All texts of a band are here, so a pair meets once for each band that it shares.
            pairs = pairs.filter(F.col("times") >= SHARED)
        else:
            # The likeliest partners first; what they don't settle is left to the last round.
            likely = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))
            pairs = pairs.withColumn("likely", likely).filter(F.col("likely") <= LIKELY)
        pairs = sessions.stored(pairs.select("a", "b"))
        spent.append(pairs)
        found = sessions.stored(similar.verified(pairs, texts, width, least))
        spent.append(found)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if roots is not None:
            sessions.drop(roots)
        roots = similar.classes(links)
        if limit is not None:
            # Bands whose texts are all in one class are done.
            named = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            left = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
            rest = sessions.stored(named.join(left, "key").select("node", "n", "key", "root", *odd))
            sessions.drop(members)
            members = rest
        # The shuffles of this round are read no more.
        del pairs, met, leaders, l, m
        sessions.release(spark)
    sessions.drop(members, *spent)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    of_class = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = of_class.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k")).alias("f"), F.sum("copies").alias("class_size"))
    named = of_class.select("node", "root").join(firsts, "root").select("node", F.col("f.id").alias("class_id"), F.col("f.k").alias("first_k"), "class_size")
    placed = seen.select("k", "id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    alone = F.col("n") == 0
    return placed.select(
        "k",
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.col("n").alias("n_shingles"),
        (alone | F.col("k").eqNullSafe(F.col("first_k"))).alias("first"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each class, in all their columns; of rows that repeat id and text one stays, and of texts without words all."""
    found = near_duplicates(docs, doc_id, text, **options)
    own = sessions.spare("k", docs.columns)
    kept = found.filter("first and n_shingles > 0").select(F.col("k").alias(own)).distinct()
    keyed = docs.withColumn(own, _key(doc_id, text))
    some = keyed.join(kept, own).dropDuplicates([own]).select(*[f"`{c}`" for c in docs.columns])
    blank = docs.filter(~F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return some.unionByName(blank)
