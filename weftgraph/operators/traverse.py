"""Impact and shortest paths as rounds over a frontier, and closures.

The queue of an ordered traversal works level by level: what the nodes of one level
put into the queue is the next one. So a round joins the frontier with its edges,
gives every visit a key that orders it as the queue would (rank of the node it comes
from, phase, place of the edge), and keeps the first visit of each node that wasn't
visited before; the next ranks follow from the keys. No task holds the graph.

Small graphs, and small ones of so many levels that rounds would take too long, go to
the kernel, one task that walks adjacency lists; how many edges there are is counted
before. Both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import model
from weftgraph.operators.kernel import IMPACT_TYPES, Graph
from weftgraph.snapshots.snapshots import drop, settle

#: Most edges that the kernel holds; edges up to which it is used at once; rounds after which it is used if it may be.
KERNEL_EDGES, FEW_EDGES, ROUNDS = 2_000_000, 50_000, 12


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with a long that rises in the given order: ranges are dealt to tasks and numbered within them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their place from 0 in the order of a long that rises by partition, such as ``numbered`` gives. What is gathered is one count for each range."""
    part = F.shiftright(order, 33)
    counts = {r["p"]: (r["n"], r["low"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("low")).collect()}
    shifts, before = [], 0
    for p in sorted(counts):
        shifts.append((p, before - counts[p][1]))
        before += counts[p][0]
    made = pa.table({"p": pa.array([p for p, _ in shifts], pa.int64()), "shift": pa.array([s for _, s in shifts], pa.int64())})
    table = F.broadcast(rows.sparkSession.createDataFrame(made))  # from Arrow: rows of Python objects would take a worker for each partition
    return rows.withColumn("p", part).join(table, "p").withColumn(name, F.col(order) + F.col("shift")).drop("p", "shift")


def _settled(edges: DataFrame) -> DataFrame:
    """(src, dst, type, seq) with seq as a long in encounter order."""
    order = ["seq"] if "seq" in edges.columns else ["src", "dst", "type"]
    return settle(numbered(edges, order, "at").select("src", "dst", "type", F.col("at").alias("seq")))


def _ids(edges: DataFrame, nodes: DataFrame | None, wanted: list[str]) -> set[str]:
    """Which of a few ids the graph has, as a declared node or the end of an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    every = ends if nodes is None else ends.unionByName(nodes.select("id"))
    return {r["id"] for r in every.filter(F.col("id").isin(wanted)).distinct().collect()}


def _kernel(edges: DataFrame, work, schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triples = [t for part in parts for t in zip(part["src"], part["dst"], part["type"])]
        yield pd.DataFrame(work(Graph(triples)), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.repartition(1).sortWithinPartitions("seq").mapInPandas(run, schema)


def impact(edges: DataFrame, node: str, types: tuple[str, ...] = IMPACT_TYPES, kernel: bool | None = None) -> DataFrame:
    """(rank, id) of what a change of ``node`` reaches, in the order of the queue. kernel: which form to use; None lets the size decide."""
    spark, schema = edges.sparkSession, "rank bigint, id string"
    graph = _settled(edges)
    size = graph.count()
    inner = lambda: _kernel(graph, lambda g: list(enumerate(g.impact(node, types))), schema)
    if kernel or kernel is None and size <= FEW_EDGES:
        return inner()
    owners = settle(model.owners(graph))
    held = graph.filter("type = 'CONTAINS'").join(owners, (F.col("dst") == F.col("member")) & (F.col("src") == F.col("owner")), "left_semi").select(F.col("src").alias("holder"), F.col("dst").alias("part"), F.col("seq").alias("place"))
    faces = graph.filter("type = 'IMPLEMENTS'")
    own = faces.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.col("seq").alias("a"))
    zero = F.lit(-1).cast("long")
    first = spark.range(1).select(F.lit(node).alias("id"), zero.alias("a"), zero.alias("b"))
    mine = held.filter(F.col("holder") == node).select(F.col("part").alias("id"), zero.alias("a"), F.col("place").alias("b"))
    theirs = held.join(own, F.col("holder") == F.col("id")).select(F.col("part").alias("id"), "a", F.col("place").alias("b"))
    seeds = first.unionByName(mine).unionByName(own.select("id", "a", zero.alias("b"))).unionByName(theirs)
    seeds = seeds.groupBy("id").agg(F.min(F.struct("a", "b")).alias("key"))
    levels = [settle(numbered(seeds, ["key"], "rank").select("id", "rank", F.lit(True).alias("hidden"), F.lit(False).alias("told")))]
    while not levels[-1].isEmpty():
        if kernel is None and len(levels) > ROUNDS and size <= KERNEL_EDGES:
            drop(*levels, owners)
            return inner()
        levels.append(_round(levels, graph, faces, held, owners, types))
    every = None
    for i, x in enumerate(levels):
        at = x.select("id", "hidden", "told", F.struct(F.lit(i).alias("level"), "rank").alias("at"))
        every = at if every is None else every.unionByName(at)
    told = every.filter("told").join(owners, F.col("id") == F.col("member"), "left").select(F.coalesce("owner", "id").alias("id"), "at").groupBy("id").agg(F.min("at").alias("at"))
    late = told.join(every.filter("hidden").select("id", F.col("at").alias("since")), "id", "left").filter("since is null or since > at")
    found = settle(numbered(late.select("id", "at"), ["at"], "n").select("id", "n"))
    drop(*levels, owners, graph)
    return ranked(found, "n", "rank").select("rank", "id")


def _round(levels: list[DataFrame], graph: DataFrame, faces: DataFrame, held: DataFrame, owners: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The next level: (id, rank, hidden, told), the first visit of each node.

    A bridge to an interface also visits its members, and a caller's visit its owner,
    both only if the visit they come with is the first of its node. Which visits are
    is found by taking all of them for valid and correcting until nothing changes.
    """
    front, none = levels[-1], F.lit(None)
    seen = levels[0].select("id")
    for x in levels[1:]:
        seen = seen.unionByName(x.select("id"))
    key = lambda phase, sub, place: F.struct("rank", F.lit(phase).alias("phase"), "seq", F.lit(sub).alias("sub"), place.cast("long").alias("place")).alias("key")
    at = front.select(F.col("id").alias("here"), "rank")
    bridge = at.join(faces, F.col("here") == F.col("src")).select(F.col("dst").alias("id"), key(0, 0, none))
    maker = at.join(faces, F.col("here") == F.col("dst")).select(F.col("src").alias("id"), key(1, 0, none))
    caller = at.join(graph.filter(F.col("type").isin(list(types))), F.col("here") == F.col("dst")).select(F.col("src").alias("id"), key(2, 0, none))
    plain = settle(bridge.unionByName(maker).unionByName(caller).groupBy("id", "key").agg(F.lit(1).alias("one")).drop("one").join(seen, "id", "left_anti"))
    with_key = lambda phase, sub, place: F.struct(F.col("key.rank").alias("rank"), F.lit(phase).alias("phase"), F.col("key.seq").alias("seq"), F.lit(sub).alias("sub"), place.cast("long").alias("place"))
    parts = plain.filter("key.phase = 0").join(held, F.col("id") == F.col("holder")).select(F.col("part").alias("to"), with_key(0, 1, F.col("place")).alias("then"), "id", "key")
    holders = plain.filter("key.phase = 2").join(owners, F.col("id") == F.col("member")).select(F.col("owner").alias("to"), with_key(2, 1, none).alias("then"), "id", "key")
    more = settle(parts.unionByName(holders).join(seen.select(F.col("id").alias("to")), "to", "left_anti"))
    valid, spent = more, [plain, more]
    while True:
        won = plain.unionByName(valid.select(F.col("to").alias("id"), F.col("then").alias("key"))).groupBy("id").agg(F.min("key").alias("key"))
        if more.isEmpty():
            break
        now = settle(more.join(won.select(F.col("id").alias("w"), F.col("key").alias("first")), (F.col("id") == F.col("w")) & (F.col("key") == F.col("first"))).select("to", "then", "id", "key"))
        spent.append(now)
        same = valid.count() == now.count() and now.join(valid, ["to", "then"], "left_anti").isEmpty()
        valid = now
        if same:
            break
    made = numbered(won, ["key"], "r").select("id", F.col("r").alias("rank"), (F.col("key.phase") == 0).alias("hidden"), ((F.col("key.phase") > 0) & (F.col("key.sub") == 0)).alias("told"))
    out = settle(made)
    drop(*spent)
    return out


def path(edges: DataFrame, source: str, target: str, nodes: DataFrame | None = None, kernel: bool | None = None) -> DataFrame:
    """(step, id) of a shortest path from ``source`` to ``target`` over all edges; ties go to the edges met first. No rows if there is none. nodes: (id) of declared nodes, which may have no edge."""
    spark, schema = edges.sparkSession, "step bigint, id string"
    graph = _settled(edges)
    if _ids(graph, nodes, [source, target]) != {source, target}:
        return spark.createDataFrame([], schema)
    if source == target:
        return spark.createDataFrame([(0, source)], schema)
    size = graph.count()
    inner = lambda: _kernel(graph, lambda g: list(enumerate(g.path(source, target))), schema)
    if kernel or kernel is None and size <= FEW_EDGES:
        return inner()
    levels = [settle(spark.range(1).select(F.lit(source).alias("id"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("came")))]
    while not levels[-1].isEmpty():
        if not levels[-1].filter(F.col("id") == target).isEmpty():
            way = [target]
            for x in reversed(levels[1:]):
                way.append(x.filter(F.col("id") == way[-1]).first()["came"])
            return spark.createDataFrame(list(enumerate(reversed(way))), schema)
        if kernel is None and len(levels) > ROUNDS and size <= KERNEL_EDGES:
            return inner()
        seen = levels[0].select("id")
        for x in levels[1:]:
            seen = seen.unionByName(x.select("id"))
        near = levels[-1].select(F.col("id").alias("came"), "rank").join(graph, F.col("came") == F.col("src")).select(F.col("dst").alias("id"), F.struct("rank", "seq").alias("key"), "came")
        first = near.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("key", "came")).alias("x")).select("id", "x.key", "x.came")
        levels.append(settle(numbered(first, ["key"], "r").select("id", F.col("r").alias("rank"), "came")))
    return spark.createDataFrame([], schema)


def closure(links: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reachable from ``start`` (id) over ``links`` (src, dst), those included: a frontier loop without order."""
    seen = settle(start.select("id").distinct())
    front = seen
    while not front.isEmpty():
        near = front.join(links, front["id"] == links["src"]).select(F.col("dst").alias("id")).distinct()
        front = settle(near.join(seen, "id", "left_anti"))
        seen = settle(seen.unionByName(front))
    return seen
