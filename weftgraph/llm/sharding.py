"""Sharding by a minimax contiguous partition of atomic groups.

Method. Documents with equal texts form an atomic group; groups stand in the
order of a hash of the text, and a shard is a run of groups. The smallest
capacity that lets ``shards`` runs hold everything is found by binary search,
each trial checked greedily (fill a run while the next group fits). The search
works on sums by hash range, finest where a cut can fall: ranges near possible
cuts are split by further hash bits until the answer doesn't depend on how they
would be split, so the result is that of the search over all single groups,
while the driver only sees range sums: 2**FIRST_BITS, and 2**MORE_BITS for each
range that is split, which are a few for each shard, and at most all ranges where
no cut can be told yet.

Law ``bytes``: the largest shard is as small as any contiguous partition of the
groups allows. Slots number the rows of a shard without gaps.

Defined results. A null text has no bytes (size 1) and crc32 0; null texts form
one group, and so do the copies of any text, which is never split. Rows with equal
keys and texts get different slots. A very long text may be larger than the mean
shard; then its group is a shard's only one. An empty table gives an empty result.
Other columns are ignored; if the key has the name of a column of the result, that
one gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sessions

#: Hash bits of the first ranges, and of each further split.
FIRST_BITS, MORE_BITS = 12, 8


class Item:
    """A run of groups in hash order: its bytes, and whether it is one group."""

    __slots__ = ("low", "bits", "bytes", "single")

    def __init__(self, low: int, bits: int, size: int, single: bool):
        self.low, self.bits, self.bytes, self.single = low, bits, size, single


def cuts_for(items: list[Item], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: index of the first item of each shard after the first, or None if ``shards`` don't suffice."""
    cuts, load = [], 0
    for i, x in enumerate(items):
        if x.bytes > capacity:
            return None
        if load + x.bytes > capacity:
            cuts.append(i)
            load = 0
            if len(cuts) >= shards:
                return None
        load += x.bytes
    return cuts


def smallest(items: list[Item], shards: int) -> int:
    """Binary search for the least capacity, items being atomic."""
    total = sum(x.bytes for x in items)
    low, high = max([-(-total // shards), *(x.bytes for x in items)]), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if cuts_for(items, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _fluid(items: list[Item], capacity: int, shards: int) -> bool:
    """Whether ``shards`` could suffice if items that aren't single could be cut anywhere."""
    runs, load = 1, 0
    for x in items:
        if x.single:
            if x.bytes > capacity:
                return False
            if load + x.bytes > capacity:
                runs, load = runs + 1, 0
            load += x.bytes
        else:
            load += x.bytes
            more = -(-load // capacity) - 1 if load > capacity else 0
            runs, load = runs + more, load - more * capacity
    return runs <= shards


def _reach(items: list[Item], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Items in which the greedy cuts fall: the least (fluid false) or the furthest (true) they can be."""
    at, load = [], 0
    for i, x in enumerate(items):
        if fluid and not x.single:
            load += x.bytes
            while load > capacity and len(at) < shards:
                at.append(i)
                load -= capacity
        else:
            if load + x.bytes > capacity and len(at) < shards:
                at.append(i)
                load = 0 if x.bytes <= capacity else x.bytes - capacity
                load = x.bytes if x.bytes <= capacity else load
            else:
                load += x.bytes
    return at


def _place(low: int) -> int:
    """A place in hash order, as Spark's signed long."""
    return low - (1 << 64) if low >= 1 << 63 else low


def plan(groups: DataFrame, shards: int) -> list[int]:
    """Cuts (hash places where a new shard begins) for a table (h long, size long) with one row per group."""
    spark = groups.sparkSession
    spot = F.shiftrightunsigned("h", 64 - FIRST_BITS)
    rows = groups.groupBy(spot.alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    items = [Item(x.r << (64 - FIRST_BITS), FIRST_BITS, x.b, x.n == 1) for x in sorted(rows, key=lambda x: x.r)]
    if not items:
        return []
    while True:
        high = smallest(items, shards)
        low, top = max(-(-sum(x.bytes for x in items) // shards), *(x.bytes for x in items if x.single), 0), high
        while low < top:
            mid = (low + top) // 2
            if _fluid(items, mid, shards):
                top = mid
            else:
                low = mid + 1
        near = _reach(items, max(low, 1), shards, False)
        far = _reach(items, high, shards, True)
        split: set[int] = set()
        if low < high:
            for k in range(max(len(near), len(far))):
                a = near[k] if k < len(near) else len(items) - 1
                b = far[k] if k < len(far) else len(items) - 1
                split |= {i for i in range(max(0, min(a, b) - 1), min(len(items), max(a, b) + 2)) if not items[i].single and items[i].bits < 64}
            if not split:
                split = {i for i, x in enumerate(items) if not x.single and x.bits < 64}
        if not split:
            cuts = cuts_for(items, high, shards)
            return [items[i].low for i in cuts]
        wanted = [(_place(items[i].low), items[i].bits) for i in split]
        fine = {}
        for bits in {b for _, b in wanted}:
            lows = [low for low, b in wanted if b == bits]
            more = min(64, bits + MORE_BITS)
            head = F.shiftleft(F.shiftrightunsigned("h", 64 - bits), 64 - bits)
            chosen = groups.join(F.broadcast(spark.createDataFrame([(x,) for x in lows], "head long")), head == F.col("head"), "left_semi")
            part = F.shiftleft(F.shiftrightunsigned("h", 64 - more), 64 - more)
            for x in chosen.groupBy(part.alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
                at = x.r & ((1 << 64) - 1)
                fine[at] = Item(at, more, x.b, x.n == 1)
        items = sorted([x for i, x in enumerate(items) if i not in split] + list(fine.values()), key=lambda x: x.low)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot (long, from 0) and grown_shard (null).

    Only (key, size, crc, hash) is shuffled. Slots come from one range
    partitioning by (shard, hash, key), written to the checkpoint folder: place in the
    partition plus the rows of the same shard in partitions before, of which
    there are as many numbers as partitions.
    """
    spark = docs.sparkSession
    words = F.col(f"`{text}`")
    sized = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.coalesce(F.octet_length(words), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(words, "UTF-8")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(words).alias("h"),
    )
    sized = sessions.stored(sized)
    groups = sessions.stored(sized.groupBy("h").agg(F.sum("size").alias("size")))
    cuts = plan(groups, shards)
    # Unsigned order of the hash as signed order.
    lifted = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    number = F.lit(0)
    for c in cuts:
        number = number + (lifted >= F.lit(_place(c ^ (1 << 63)))).cast("int")
    placed = sized.withColumn("shard", number.cast("int"))
    n = sessions.partitions(spark)
    spread = placed.repartitionByRange(n, "shard", lifted, "key").sortWithinPartitions("shard", lifted, "key").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    spread = sessions.stored(spread)
    counts = spread.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start")).collect()
    offsets, seen = [], {}
    for x in sorted(counts, key=lambda x: (x["shard"], x["part"])):
        offsets.append((x["shard"], x["part"], seen.get(x["shard"], 0) - x["start"]))
        seen[x["shard"]] = seen.get(x["shard"], 0) + x["n"]
    table = spark.createDataFrame(offsets, "shard int, part int, shift long")
    columns = {"size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": F.col("place") + F.col("shift"), "grown_shard": F.lit(None).cast("int")}
    return spread.join(F.broadcast(table), ["shard", "part"]).select(
        F.col("key").alias(key), *[c.alias(sessions.spare(n, [key])) for n, c in columns.items()]
    )
