import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa

from weftgraph.llm import linededup, neardup, queries, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(text, width=5):
    ws = WORD.findall(text or "")
    return [tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []


def shingles(text, width=5):
    return set(runs(text, width))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def weighted(a, b):
    """Weighted Jaccard of two Counters."""
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def vary(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    texts = []
    for _ in range(n // 8):
        base = make(rng.randint(3, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            texts.append(" ".join(vary(rng, base, rng.randint(0, 4))))
    hot = make(120)
    texts += [" ".join(vary(rng, hot, rng.randint(0, 3))) for _ in range(60)] + [" ".join(hot)] * 40
    passage = make(60)
    texts += [" ".join(make(150) + passage + make(100)) for _ in range(15)] + [None, "", " \n", None]
    # One set of shingles, but other weights: similar only where these are.
    often = make(20)
    texts += [" ".join(passage + often * k) for k in (1, 2, 3, 8, 8, 9, 30, 31)]
    rng.shuffle(texts)
    return texts


def components(texts):
    sets = [Counter(runs(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if weighted(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus(11)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, k int, node string").repartition(4)
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    want = components(texts)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    assert {i for i, r in got.items() if r["first"]} == {i for i, c in enumerate(want) if i == c}
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, None)]
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([("None", "1", 3), ("1", "1", 3), ("1", "1", 3), ("None", "None", 1), ("2", "2", 1)])
    assert neardup.keep_first(spark.createDataFrame(rows, schema)).count() == 3


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(3):
        n = 200
        element = rng.integers(0, 2**63, size=n).astype(np.uint64)
        a, b = rng.gamma(1.0, 1.5, size=n), rng.gamma(1.0, 1.5, size=n)
        a[:50], b[150:] = 0, 0
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        owner = np.repeat([0, 1], n)
        weight = np.concatenate([a, b])
        ok = weight > 0
        sig = neardup.dart_signatures(owner[ok], np.concatenate([element, element])[ok], weight[ok], 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * math.sqrt(true * (1 - true) / 2048)


def test_classes_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 205), (205, 203)] + [(300, 300 + i) for i in range(1, 40)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in similar.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[203] == 200 and got[339] == 300


def removed_lines(docs):
    earlier, out = [], {}
    for i, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if len(WORD.findall(line)) < 5:
                continue
            s = shingles(line)
            if any(jaccard(s, e) >= 0.8 for e in earlier):
                out.setdefault(i, []).append(n)
            earlier.append(s)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    make = lambda k: [f"w{rng.randrange(500)}" for _ in range(k)]
    pool = [make(rng.randint(1, 60)) for _ in range(60)]
    hot = make(50)
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = rng.random()
            base = hot if x < 0.3 else rng.choice(pool)
            lines.append(" ".join(base if x > 0.9 else vary(rng, base, rng.randint(0, 2)) if x > 0.2 else make(20)))
        docs.append((i, "\n".join(lines) if rng.random() > 0.05 else None))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int").repartition(5)
    got = linededup.clean(df)
    assert got.columns == ["doc_id", "text", "line", "removed_lines"]
    rows = {r.doc_id: r for r in got.collect()}
    want = removed_lines(docs)
    assert {i: r.removed_lines for i, r in rows.items() if r.removed_lines} == want
    for i, t in docs:
        assert rows[i].text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(i, [])))


def test_lines_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert linededup.clean(spark.createDataFrame([], schema)).count() == 0
    line = "one two three four five six"
    rows = [(None, line), (3, line + "\n" + line), (3, line + "\n" + line), (4, None), (5, "")]
    got = sorted((str(r.doc_id), r.removed_lines) for r in linededup.clean(spark.createDataFrame(rows, schema)).collect())
    assert got == [("3", [1]), ("3", [1]), ("4", []), ("5", []), ("None", [0])]


def line_links(docs, least_words=5):
    """(class, number of links) of each document by brute force."""
    lines = [(i, frozenset(shingles(x))) for i, t in docs for x in (t or "").split("\n") if len(WORD.findall(x)) >= least_words]
    root, links = {i: i for i, _ in docs}, {i: 0 for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, s) in enumerate(lines):
        for j, e in lines[:x]:
            if s == e or jaccard(s, e) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                if s != e:
                    links[i] += 1
                    links[j] += 1
    return {i: (find(i), links[i]) for i, _ in docs}


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", 20)
    rng = random.Random(9)
    make = lambda k: [f"w{rng.randrange(900)}" for _ in range(k)]
    hot, pool = make(50), [make(rng.randint(5, 40)) for _ in range(40)]
    docs = []
    for i in range(150):
        bases = [hot] if i < 70 else [rng.choice(pool) for _ in range(rng.randint(0, 2))]
        lines = [" ".join(vary(rng, base, rng.randint(0, 1))) for base in bases] + [" ".join(make(12))]
        docs.append((i, "\n".join(lines) if rng.random() > 0.05 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = line_links(docs)
    assert max(n for _, n in want.values()) > 30
    rows = linededup.linked(df).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in rows} == want and len(rows) == len(docs)
    gone = removed_lines(docs)
    assert {r.doc_id: r.removed_lines for r in rows if r.removed_lines} == gone


def test_short_lines_go_as_copies_in_query_and_stage(spark, tmp_path):
    docs = [(i, f"own line number {i} of text\nhome news about us\n" + ("top" if i % 2 else "home news about")) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: "", 1: "1", **{i: "1,2" for i in range(2, 6)}}
    assert {r.doc_id: r.removed for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == want
    table = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table, "").collect()}
    assert left == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if str(n) not in want[i].split(",")) for i, t in docs}
    rows = {r.doc_id: (r.class_id, r.links) for r in linededup.linked(table, min_words=1).collect()}
    assert rows == line_links(docs, 1)


def test_token_sets_are_named_by_whole_hashes():
    # Tokens that agree in the bits of the prefixes and differ below them.
    unit, low = np.array([0, 1, 2, 2, 3, 3, 3]), np.array([1, 2, 1, 2, 2, 1, 1])
    whole = (np.uint64(77) << np.uint64(64 - linededup.TOKEN_BITS)) + low.astype(np.uint64)
    levels = np.zeros(1 << linededup.BUCKET_BITS, np.uint64)
    _, some, _, n = linededup._ordered(unit, whole >> np.uint64(64 - linededup.TOKEN_BITS), levels)
    node = linededup._nodes(unit, whole, some, n)
    assert len(set(node.tolist())) == 3 and node[2] == node[3]


def test_tokens_are_looked_at_whole_or_passed_on(monkeypatch):
    rng = np.random.default_rng(4)
    token = np.sort(rng.choice([1, 2, 3, 5, 8, 9, 12], size=600, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.04, 0.01]))
    node = rng.integers(0, 300, 600)
    n, pos, odd = 2 + node % 50, (node * 7 + token) % 12, node // 3 % 8
    n[node % 50 == 7] = linededup.MANY
    rows = [token, node, (odd << 32 | n << 16 | pos).astype(np.int64)]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in rows], names=["token", "node", "sketch"]) for i in range(0, 600, size)]
        return [x for b in linededup._shared(0.8)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns[:3]))]

    whole = run(600)
    assert sorted(whole) == sorted(run(7)) == sorted(run(64))
    groups = {}
    for t, d, m, p, o in zip(token.tolist(), node.tolist(), n.tolist(), pos.tolist(), odd.tolist()):
        groups.setdefault(t, {})[d] = (m, p, o)
    for t, group in groups.items():
        many = any(m == linededup.MANY for m, _, _ in group.values())
        early = [m for m, p, _ in group.values() if m == linededup.MANY or p <= m - math.ceil(2 * 0.8 / 1.8 * m - 1e-9)]
        keep = {d for d, (m, _, _) in group.items() if early and m >= min(early) and (m * 0.8 <= max(early) + 1e-9 or many)}
        if len(keep) <= linededup.PAIRED:
            may = lambda x, y: linededup.MANY in (x[0], y[0]) or min(x[0], y[0]) >= 0.8 * max(x[0], y[0]) - 1e-9 and (x[2] ^ y[2]).bit_count() <= 0.2 / 1.8 * (x[0] + y[0]) + 1e-6 and min(x[0] - x[1], y[0] - y[1]) >= 0.8 / 1.8 * (x[0] + y[0]) - 1e-9
            keep = {d for d in keep if any(d != e and may(group[d], group[e]) for e in keep)}
        want = [(t, d, len(keep)) for d in sorted(keep)] if len(keep) > 1 else []
        assert sorted(x for x in whole if x[0] == t) == want
    monkeypatch.setattr(linededup, "GROUP", 40)
    for size in (7, 64, 600):
        some = run(size)
        large = {t for t, _, n in some if n is None}
        assert (size == 600 or 1 in large) and sorted(x for x in some if x[0] not in large) == sorted(x for x in whole if x[0] not in large)
        assert {(t, d) for t, d, _ in some if t in large} == {(t, d) for t in large for d in groups[t]}


def test_matrices_in_blocks_agree_with_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(3)]
    sets = []
    for i in range(50):
        own = base[i % 3].copy()
        own[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    levels = rng.integers(0, 5, 1 << linededup.BUCKET_BITS).astype(np.uint64)
    for value in (*base[0][:3], sets[1][5]):
        token = int(value >> np.uint64(64 - linededup.TOKEN_BITS))
        own = [x for x in sets if value in x]  # all sets of a tile have its token
        n = len(own)
        for side in (np.zeros(n, np.int64), np.arange(n) % 2):
            whole = linededup._similar(own, side, token, levels, 0.8)
            monkeypatch.setattr(linededup, "CELLS", 400)
            assert (linededup._similar(own, side, token, levels, 0.8) == whole).all()
            monkeypatch.undo()
            order = lambda x: int(linededup._order(np.array([x], np.uint64), levels)[0])
            for i in range(n):
                for j in range(n):
                    both = set(own[i].tolist()) & set(own[j].tolist())
                    want = i != j and (not side.any() or side[i] != side[j]) and len(both) >= 0.8 * len(set(own[i].tolist()) | set(own[j].tolist())) and min(map(order, both)) == order(value)
                    assert whole[i, j] == want
        assert n > 5 or value == sets[1][5]
