import random
from collections import Counter

import corpus_pipeline
import numpy as np
from test_mix_shard import filled
from test_similar import WORD, components, removed_lines, vary
from test_words_quality import plain
from weftgraph.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    """Clean, repeating and short texts, near copies of whole documents, shared lines, nulls and one repeated row."""
    rng = random.Random(4)
    make = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    lines = lambda ws: "\n".join(" ".join(ws[i : i + 20]) for i in range(0, len(ws), 20))
    texts = [lines(make(rng.randint(60, 240))) for _ in range(60)]
    texts += [" ".join(make(30) * 9), "too short", None, "", lines(make(50))]
    base = make(200)
    texts += [" ".join(vary(rng, base, rng.randint(0, 2))) for _ in range(6)]
    shared = " ".join(make(20))
    texts += [f"{shared}\n{lines(make(100))}" for _ in range(8)]
    rng.shuffle(texts)
    rows = [(i, t, "en", [None, "a", "b", "c"][rng.randrange(4)], len(t or "")) for i, t in enumerate(texts)]
    return rows + [r for r in rows if r[1] and len(r[1]) > 400][:1]


def verdict(text):
    n, chars, _, _, again, longest, covered = plain(text)
    return n >= 50 and 100 * again <= 50 * n and covered <= 0.5 * chars and longest <= max(60, n * 0.25)


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got.append([tuple(r) for r in docs.collect()])

    good = [r for r in rows if verdict(r[1])]
    assert Counter(got[0]) == Counter(good) and len(good) < len(rows)

    gone = removed_lines(set((r[0], r[1]) for r in good))
    cut = lambda r: "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone.get(r[0], []))
    cleaned = [(r[0], t, r[2], r[3], len(t)) for r in good if WORD.search(t := cut(r))]
    assert Counter(got[1]) == Counter(cleaned) and gone

    once = sorted(set(cleaned))
    roots = components([r[1] for r in once])
    assert sorted(got[2]) == [r for i, r in enumerate(once) if roots[i] == i]

    sizes, taken = Counter(), Counter()
    for r in got[2]:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in got[3]:
        taken[r[3]] += len(WORD.findall(r[1]))
    most = max(len(WORD.findall(r[1])) for r in got[2])
    for s, target in filled(sizes).items():
        assert abs(taken[s] - target) <= most
    assert set(got[3]) <= set(got[2]) and max(Counter(got[3]).values()) <= 3

    texts = {r[0]: r[1] for r in got[3]}
    vocab = pieces.vocabulary()
    assert Counter(r[0] for r in got[4]) == Counter(r[0] for r in got[3])
    for doc_id, n, ids, lossless in got[4]:
        back = np.frombuffer(ids, np.uint16)
        assert lossless and n == len(back) and vocab.decode(back.tolist()) == texts[doc_id]


def test_run_over_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_gives_the_stages_rows_and_keeps_its_result_only(spark):
    from pathlib import Path

    base = Path(spark.conf.get("spark.checkpoint.dir"))
    folder = "/root/testdata/sf0.001"
    before = {p.name for p in next(base.iterdir()).iterdir()} if any(base.iterdir()) else set()
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in docs.collect())
    (root,) = base.iterdir()
    runs = [p for p in root.iterdir() if p.name.startswith("pipeline-") and p.name not in before]
    assert len(runs) == 1 and [p.name for p in runs[0].iterdir() if p.is_dir()] == [str(len(corpus_pipeline.STAGES) - 1)]
