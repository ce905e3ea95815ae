import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mixing, sharding


def filled(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, full, target = float(sum(sizes.values())), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def docs_of(spark, seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "ä", "Z", None, "hot"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 30]) if rng.random() > 0.05 else None, rng.choice(sources + ["hot"] * 6), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def test_targets_and_taken(spark):
    rows, df = docs_of(spark, 1)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    got = mixing.mix(df, weights=(5, 2, 1)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    full = mixing.mixed(df)
    assert full.columns == df.columns and full.count() == sum(r.copies for r in got)


def test_mix_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None)], df.schema)
    assert [r.taken for r in mixing.mix(one).collect()] == [0, 0]


@pytest.mark.parametrize("text", ["", "a", "a\x0bb\x1c c", "é\xa0b"])
def test_words_are_counted_alike(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.n_words(F.col("t")).alias("n")).first().n == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def minimax(sizes, shards):
    low = max([*sizes, 0])
    while True:
        runs, load = 1, 0
        for s in sizes:
            if load + s > low:
                runs, load = runs + 1, 0
            load += s
        if runs <= shards:
            return low
        low += 1


@pytest.mark.parametrize("seed", range(4))
def test_shards_are_minimax(spark, seed):
    rng = random.Random(seed)
    texts = ["t" * rng.randint(0, 60) + str(rng.randint(0, 40)) for _ in range(300)] + ["hot"] * 120 + [None] * 3
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, shards=5).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    by_text, load, slots = {}, {}, {}
    for r in got:
        t = texts[r.doc_id]
        assert r.size == len(t or "") + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert by_text.setdefault(t, r.shard) == r.shard
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(set(texts), key=lambda t: hashes[t] & (2**64 - 1))
    assert max(load.values()) == minimax([texts.count(t) * (len(t or "") + 1) for t in order], 5)
    assert sharding.shard(df.limit(0)).count() == 0


def test_plan_refines_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rng = random.Random(9)
    for _ in range(3):
        groups = [(rng.getrandbits(64) - 2**63, rng.randint(1, 50)) for _ in range(60)]
        df = spark.createDataFrame(groups, "h long, size long")
        cuts = sharding.plan(df, 4)
        order = sorted((h & (2**64 - 1), s) for h, s in groups)
        load = [0] * (len(cuts) + 1)
        for h, s in order:
            load[sum(h >= c for c in cuts)] += s
        assert max(load) == minimax([s for _, s in order], 4)
