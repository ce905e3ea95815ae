import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, topk


def brute(rows, asks, k):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid[i] = [int(np.floor(64 * float(x))) for x in v]
    out = set()
    for q in (i for i in valid if i in asks):
        scored = sorted((-sum(a * b for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("seed,spread", [(0, 0.0), (1, 1.0), (2, 3.0)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "STRIPE", 3)
    monkeypatch.setattr(topk, "STEPS", 4)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, 6))
    rows = [(i, (base[rng.integers(8)] + 0.02 * rng.normal(size=6)).astype(float) * float(np.exp(spread * rng.normal()))) for i in range(300)]
    rows = [(i, [float(x) for x in v]) for i, v in rows] + [(300 + i, [1.0] * 6) for i in range(80)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")] * 6), (404, []), (405, [0.5]), (None, [1.0] * 6), (410, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()}
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 7)


def test_top_k_large_numbers_and_few_rows(spark):
    rows = [(0, [1e8, 1e8]), (20, [1e8, -1e8]), (1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()} == brute(rows, {0, 20}, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_bucket_prunes_but_loses_nothing():
    rng = np.random.default_rng(4)
    rows = rng.integers(-60, 60, size=(200, 5))
    queries = rows[:20] + rng.integers(-2, 3, size=(20, 5))
    ids = np.arange(200)
    scores = queries @ rows.T
    scores[np.arange(20), np.arange(20)] = -(10**9)
    floors = np.sort(scores, axis=1)[:, -5]
    q, v, s = topk.search_bucket(ids[:20], queries, floors, ids, rows, 5)
    parted = topk._Best(ids[:20], queries, np.full(20, topk._LOW), 5)
    for part in np.array_split(rng.permutation(200), 7):
        parted.meet(ids[part], rows[part])
    for i in range(20):
        order = sorted((-scores[i, j], j) for j in range(200))[:5]
        assert sorted(zip(v[q == i], s[q == i])) == sorted((j, -x) for x, j in order)
        assert sorted(zip(parted.vec[parted.at == i], parted.score[parted.at == i])) == sorted((j, -x) for x, j in order) and parted.floors[i] == -order[-1][0]


def test_template_is_reversible():
    rng = random.Random(2)
    parts = ["\\", "###", "</turn>", "#", "\\3", "\\/", " ", "\n", ": ", "é", ")", "Other("]
    for _ in range(500):
        role = rng.choice(["user", "assistant", "system", "", "User", "to)ol\\", "###"])
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        turn, a, b = chat.render(role, text)
        assert chat.parse(turn) == (role, text, a, b)
        assert "###" not in turn[a:b] and "</turn>" not in turn[a:b]


def test_fold_of_events(spark):
    log = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 1, 0, "delta", None, "lo"), (1, 2, 1, "delta", "assistant", "bad"),
        (1, 3, 1, "regenerate", None, "Go"), (1, 4, 1, "delta", None, "od"), (1, 5, 0, "edit", None, "Hi"), (1, 6, 2, "delta", "user", "x"),
        (1, 7, 2, "delete", None, None), (2, 0, 0, "delta", "assistant", None), (None, 0, 0, "delta", "user", "n"),
    ]
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), chat.EVENTS)
    got = [(r.conv_id, r.turn, *chat.parse(r.rendered)[:2]) for r in chat.format_log(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "user", "Hi"), (1, 1, "assistant", "Good"), (2, 0, "assistant", ""), (None, 0, "user", "n")], key=str)


def test_digest_of_conversations(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a\\b ### x", "é</turn>"]), "x") for c in range(30) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in chat.digest(chat.format_log(chat.events_of(df))).collect()}
    for c in range(30):
        mine = [(r or "", t or "") for i, _, r, t, _ in rows if i == c]
        said = "".join(t for r, t in mine if r == "assistant")
        assert got[c].n_turns == len(mine) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in mine)
    assert chat.digest(chat.format_log(chat.events_of(df.limit(0)))).count() == 0


def test_the_log_of_a_table_holds_every_kind_out_of_order(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"text {c} of turn {t}, \u00e9\u6f22 ###") for c in range(6) for t in range(9)] + [(2, 3, "user", "again"), (2, 3, "user", "again"), (7, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(df)
    events = log.collect()
    assert {e.kind for e in events} == {"delta", "edit", "regenerate", "delete"}
    assert any(a.conv_id == b.conv_id and a.msg == b.msg and a.seq > b.seq for a, b in zip(events, events[1:]))
    turns = chat.format_log(log.orderBy(F.rand(3))).collect()
    got = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        role, text, _, _ = chat.parse(r.rendered)
        got.setdefault(r.conv_id, []).append((role, text))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
