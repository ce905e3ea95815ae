"""Exact top-k search by inner product, with norm-bucketed retrieval.

Method. Vectors are range-partitioned by length, longest first, into buckets of
about ``BUCKET`` rows; each bucket is packed into one row with its greatest
length. The first bucket is scored for every query, which gives each query a
lower bound of its k-th score. Buckets fall in length, so a block of queries needs
a prefix of them: those whose greatest length, by the product of lengths, can reach
the bound of one of its queries. A task takes a block through ``STRIPE`` buckets of
that prefix, in order, and keeps the k best of each query so far, so bounds rise
from bucket to bucket. Inside a bucket the bound becomes a local cosine threshold
for each query: if it is over 1 the bucket is pruned for that query; if it is high,
candidates are pruned by their normalised coordinates along the query's ``FOCUS``
largest ones; else by length alone, as a prefix of the bucket. What is left is
verified by exact products, and the k best of each query and stripe are merged.

Exactness. Components are integers. Products are taken in double precision when
no partial sum can leave 2**53, else in Python integers; bounds are integers.
Scores beyond the range of long are cut to it.

Defined results. Vectors that are null, or hold a null or a value that isn't
finite, take no part. Shorter vectors count as padded with zeros. The id names
the row: a query's candidates are all rows with another id. Rows that repeat an
id take part as one vector, the least by order of components. Rows whose id is
null take no part. Equal scores go to the smaller id. An empty table gives an
empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sessions

#: Rows of a bucket of candidates, and of a block of queries (about).
BUCKET, BLOCK = 1024, 256
#: Buckets that a task takes a block of queries through.
STRIPE = 64
#: Local cosine threshold from which coordinates prune, and coordinates of a query that do.
STEEP, FOCUS = 0.5, 4
#: Most steps in which the lengths of buckets are known to the driver.
STEPS = 4096
#: No lower bound.
_LOW = -(2**63)
_EXACT = 2.0**53
_PACKED = "part int, sub int, n int, most double, ids binary, vectors binary"
_NAMES = ["part", "sub", "n", "most", "ids", "vectors"]


def components(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null unless all components are finite."""
    fits = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fits, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, sub = [], [], 0
        part = None

        def out():
            rows = held
            width = max((len(r) for r in rows), default=0)
            m = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            most = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
            kind = np.int16 if m.size == 0 or np.abs(m).max() < 2**15 else np.int64
            data = np.array([kind().itemsize, width], np.int64).tobytes() + m.astype(kind).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sub], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([most]), pa.array([np.array(held_ids, np.int64).tobytes()], pa.binary()), pa.array([data], pa.binary())], names=_NAMES)

        for batch in batches:
            for p, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                part = p
                held_ids.append(i)
                held.append(v)
                if len(held) >= size:
                    yield out()
                    held_ids, held, sub = [], [], sub + 1
        if held:
            yield out()

    return run


def _unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, width = np.frombuffer(vectors[:16], np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int16 if size == 2 else np.int64, offset=16).reshape(-1, int(width))


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two integer matrices."""
    width = max(queries.shape[1], rows.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (queries, rows))
    bound = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def search_bucket(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score): the k best of a bucket for each query, as far as they reach the query's floor.

    floors: a lower bound of each query's k-th score, as long (_LOW: none yet).
    """
    lengths = _lengths(rows)
    order = np.argsort(-lengths, kind="stable")
    ids, rows, lengths = ids[order], rows[order], lengths[order]
    q_len = _lengths(queries)
    most = lengths[0] if len(lengths) else 0.0
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floors > 0, floors / (q_len * most), -np.inf)
    live = np.flatnonzero(~(local > 1 + slack))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(q: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= floors[q]) & (ids[at] != query_ids[q])
        at, scores = at[ok], scores[ok]
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ok = scores >= least
            at, scores = at[ok], scores[ok]
            best = np.lexsort((ids[at], -scores))[:k]
            at, scores = at[best], scores[best]
        found.append((np.full(len(at), q), ids[at], scores))

    plain = [q for q in live if not local[q] >= STEEP]
    if plain:
        # Length pruning: a prefix of the bucket is long enough for any of these queries.
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floors[plain] > 0, floors[plain] / q_len[plain], 0.0)
        upto = np.searchsorted(-lengths, -need * (1 - slack), "right")
        scores = products(queries[plain], rows[: upto.max()])
        for i, q in enumerate(plain):
            keep(q, np.arange(upto[i]), scores[i, : upto[i]])
    steep = [q for q in live if local[q] >= STEEP]
    if steep:
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(lengths[:, None] > 0, rows / lengths[:, None], 0.0)
        for q in steep:
            focus = np.argsort(-np.abs(queries[q, : rows.shape[1]]), kind="stable")[:FOCUS]
            # Cosine >= t needs x p + |rest of x| |rest of p| >= t for the coordinates in focus.
            x, p = queries[q, focus] / q_len[q], unit[:, focus]
            reach = p @ x + np.sqrt(np.maximum(0.0, 1 - x @ x)) * np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1)))
            cand = np.flatnonzero((reach >= min(local[q], 1.0) - 1e-7) & (lengths * q_len[q] >= floors[q] * (1 - slack)))
            keep(q, cand, products(queries[q : q + 1], rows[cand])[0])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.queries, self.floors, self.k = ids, queries, floors.copy(), k
        self.at, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        more = search_bucket(self.ids, self.queries, self.floors, ids, rows, self.k)
        at, vec, score = (np.concatenate(x) for x in zip((self.at, self.vec, self.score), more))
        order = np.lexsort((vec, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.floors[np.concatenate([self.at, more[0]])[last]] = score[last]
        self.at, self.vec, self.score = np.concatenate([self.at, more[0]])[kept], vec[kept], score[kept]

    def batch(self) -> pa.RecordBatch:
        return _found_batch((self.ids[self.at], self.vec, self.score))


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _found_batch(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """One row (query_id, rank, vec_id, score) for each of the k best candidates of each query row.

    is_query: condition on ``vectors`` that picks the queries. The candidates are
    never replicated beyond the query blocks that can need their bucket.
    """
    spark = vectors.sparkSession
    sessions.prepare(spark)
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), components(F.col(f"`{embedding}`"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    valid = sessions.stored(named.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("len", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    rows, asked = valid.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("int"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = -(-rows // BUCKET)
    # part 0 holds the longest vectors.
    dealt = valid.repartitionByRange(parts, F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id").select(F.spark_partition_id().alias("part"), "id", "v")
    buckets = sessions.stored(dealt.mapInArrow(_pack(BUCKET), _PACKED))
    parts = buckets.agg(F.max("part")).first()[0] + 1
    blocks = -(-asked // BLOCK)
    asks = valid.filter("q").repartition(blocks, "id").select(F.spark_partition_id().alias("part"), "id", "v").mapInArrow(_pack(BLOCK), _PACKED)
    # The longest bucket: at most BUCKET rows.
    first = buckets.orderBy("part", "sub").limit(1).collect()[0]
    lead_ids, lead = _unpack(first["ids"], first["vectors"])
    lead_ids, lead = lead_ids.copy(), lead.copy()
    # Greatest lengths, falling, in at most STEPS steps of as many buckets each.
    step = -(-parts // STEPS)
    coarse = buckets.groupBy(F.floor(F.col("part") / step).alias("s")).agg(F.max("most").alias("top")).orderBy("s").collect()
    falling = np.array([x["top"] for x in coarse])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, reach, upto = [], [], []
            for ids, data in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                q_ids, q = _unpack(ids, data)
                scores = products(q, lead)
                scores[q_ids[:, None] == lead_ids[None, :]] = _LOW
                kth = np.partition(scores, -k, axis=1)[:, -k] if len(lead) >= k else np.full(len(q), _LOW, np.int64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(kth > 0, kth / _lengths(q), 0.0)
                floors.append(kth.tobytes())
                reach.append(float(need.min()) * (1 - 1e-9))
                upto.append(min(parts, step * int((falling >= reach[-1]).sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary()), pa.array(reach, pa.float64()), pa.array(upto, pa.int32())], names=[*_NAMES, "floors", "reach", "upto"])

    seeded = sessions.stored(asks.mapInArrow(seed, _PACKED + ", floors binary, reach double, upto int"))
    # Blocks meet the prefix of buckets that they need; only ids are paired, contents follow by join.
    tops = buckets.groupBy("part").agg(F.max("most").alias("top"))
    wanted = seeded.filter("upto > 0").select(F.col("part").alias("block"), F.col("sub").alias("slice"), "reach", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("part"))
    due = wanted.join(tops, "part").filter(F.col("top") >= F.col("reach")).select("block", "slice", F.floor(F.col("part") / STRIPE).cast("int").alias("stripe"), "part")
    body = due.join(buckets.select("part", "sub", "ids", "vectors"), "part").select("block", "slice", "stripe", "part", "sub", "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
    heads = due.select("block", "slice", "stripe").distinct().join(seeded.select(F.col("part").alias("block"), F.col("sub").alias("slice"), "ids", "vectors", "floors"), ["block", "slice"])
    head = heads.select("block", "slice", "stripe", F.lit(-1).alias("part"), F.lit(0).alias("sub"), "ids", "vectors", "floors")
    order = ["block", "slice", "stripe", "part", "sub"]
    met = head.unionByName(body).repartition(sessions.partitions(spark), "block", "slice", "stripe").sortWithinPartitions(*order)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for part, ids, data, floors in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6, 7))):
                a_ids, a = _unpack(ids, data)
                if part < 0:
                    if best is not None:
                        yield best.batch()
                    best = _Best(a_ids, a, np.frombuffer(floors, np.int64), k)
                else:
                    best.meet(a_ids, a)
        if best is not None:
            yield best.batch()

    found = met.mapInArrow(verify, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
