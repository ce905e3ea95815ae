"""Mixing sources to target weights, with DataFrame operations only.

Method. Sizes (words) are summed by source, and targets found by filling: each
source gets its weight's share, but at most ``cap`` times its size, and what is
over is shared again by weight. A target is whole passes over the source plus a
rest. For the rest each document has a fixed 64-bit hash; words are summed by
source and hash bucket, the bucket in which the running sum passes the rest is
found, and only that bucket is split again by the next bits, until the buckets
hold one hash value each. The nested thresholds found this way are compared
with the hash of each row: no documents are sorted, and a larger budget always
keeps what a smaller one kept.

Defined results. A null text has size 0 and takes part with 0 words; so does an
empty one. A null source is a source of its own, the last in order. Rows that agree
in the key columns share one hash and are taken together, ties and repeated rows
alike. A very long text may be larger than what its source has left; it is taken if
that comes nearer to the target. An empty table gives an empty result. Column names
of the input don't matter: inner names are prefixed.

Sources are ranked against each other in one task, as a table of one row for each;
so a source must be a name among thousands or millions, not one for each document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sessions

#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits of one level. Three levels leave one hash value in 2**48 to a bucket.
BITS = 12
LEVELS = 4


#: Most rows, and most characters of names, that a table of sources may have to be broadcast; beyond that Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 10_000, 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its measured size is within the bounds."""
    rows, chars = table.agg(F.count(F.lit(1)), F.sum(F.length("source"))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS else table


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets by source for a table (source, source_size): adds weight and target.

    One row per source comes in. A source whose cap is reached before its share
    has a smaller ratio of cap to weight than any other that isn't, so with
    sources in the order of that ratio the full ones form a prefix, and the
    level at which the others are cut follows from sums over it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source that is not full fixes the level; later ones would count it as full, which gives a lower one.
    ranked = named.withColumn("level", F.when(F.col("ratio") >= level, level))
    cut = F.max("level").over(all_rows)
    return ranked.select("source", "source_size", "weight", F.when(cut.isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * cut)).alias("target"))


def mix(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: the key and ``carry`` columns, source, size, source_size, target, copies (times taken) and taken (words).

    The sizes are written once to the shared checkpoint folder, so the levels
    below don't read the texts again; ``carry`` columns are written with them.
    """
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"__key_{c}") for c in key],
        *[F.col(f"`{c}`").alias(f"__carry_{c}") for c in carry],
        F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]).alias("h"),
    )
    sized = sessions.stored(sized)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sums, weights, cap).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = wanted.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
    wanted = sessions.stored(wanted)
    edge = wanted.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    bounds = None
    for level in range(LEVELS):
        shift = 64 - BITS * (level + 1)
        prefix = F.shiftrightunsigned("h", shift)
        inside = F.lit(True) if level == 0 else F.shiftrightunsigned("h", shift + BITS) == F.col("e.prefix")
        rows = sized.select("source", "size", "h").alias("d").join(_small(edge).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & inside)
        buckets = rows.groupBy("d.source", "e.left", prefix.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("upto", F.sum("words").over(run)).withColumn("under", F.col("upto") - F.col("words"))
        # The bucket in which the budget ends: the first whose running sum passes it.
        found = summed.filter((F.col("upto") > F.col("left")) & (F.col("under") <= F.col("left")))
        edge = found.groupBy("source").agg(F.min(F.struct("bucket", "under", "left", "words")).alias("x")).select("source", (F.col("x.left") - F.col("x.under")).alias("left"), F.col("x.bucket").alias("prefix"), F.col("x.words").alias("words"))
        edge = sessions.stored(edge)
        bounds = edge
    # What is left in the last bucket is taken if that comes nearer to the target.
    last = 64 - BITS * LEVELS
    cut = bounds.select("source", (F.col("prefix") + F.when(2 * F.col("left") >= F.col("words"), 1).otherwise(0)).alias("cut"))
    plan = wanted.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select("w.*", "c.cut")
    joined = sized.alias("d").join(_small(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    extra = F.when((F.col("p.rest") > 0) & (F.col("p.cut").isNull() | (F.shiftrightunsigned("d.h", last) < F.col("p.cut"))), 1).otherwise(0)
    copies = (F.col("p.passes") + extra).cast("long")
    return joined.select(
        *[F.col(f"d.__key_{c}").alias(c) for c in key],
        *[F.col(f"d.__carry_{c}").alias(c) for c in carry if c not in key],
        F.col("d.source").alias("source"),
        F.col("d.size").alias("size"),
        F.col("p.source_size").alias("source_size"),
        F.col("p.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("d.size")).alias("taken"),
    )


def mixed(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    names = docs.columns
    row = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)], F.col(f"`{text}`").alias("__t"), F.col(f"`{source}`").alias("__s"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    taken = mix(row, tuple(f"__k{i}" for i in range(len(key))), "__t", "__s", carry=("__row",), **options)
    return taken.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")
