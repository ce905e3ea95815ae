"""Very long texts, repeated rows and clashing columns, through every operator that reads texts."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, language, leaks, linededup, mixing, neardup, pieces, quality, sharding

LONG = ["x" * 3_000_000, "word " * 400_000, "".join(f"line {i} of it all\n" for i in range(60_000)), "\u6f22\u5b57" * 300_000, "a b\n" * 200_000]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t)) for i, t in enumerate(LONG)] + [(9, None, None, None, None), (9, None, None, None, None), (None, "", "en", "s", 0), (1, LONG[1], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def test_long_texts(table):
    assert quality.assess(table).filter("n_words > 100000").count() == 4
    assert {r.doc_id: r.class_size for r in neardup.near_duplicates(table).collect()}[1] == 2
    assert mixing.mix(table).agg(F.sum("size")).first()[0] == mixing.mix(table).count() * 0 + sum(len(t.split()) for t in LONG) + 400_000
    assert sharding.shard(table, shards=3).agg(F.sum("size")).first()[0] == sum(len(t.encode()) + 1 for t in LONG) + 2_000_001 + 3
    assert language.predict(table, language.fit(table), keep=(F.col("doc_id"),)).count() == 9
    assert leaks.find(table).count() == 9
    got = pieces.tokenize(table).collect()
    assert len(got) == 9 and all(r.lossless for r in got)
    log = chat.events_of(table.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), "source", "text").withColumnRenamed("source", "role"))
    assert chat.digest(chat.format_log(log)).first().n_turns == 9
    left = {r.doc_id: r for r in linededup.linked(table, min_words=1).collect()}
    assert left[4].text == "a b\n" and len(left[4].removed_lines) == 199_999 and left[2].removed_lines == []


CLASHES = ["k", "gone", "parts", "removed_lines", "__k", "__gone", "__text", "__key", "__t", "__s", "__row", "__copy", "__k0", "node", "root", "row", "h", "size", "copies", "key", "line", "base", "every", "n_words", "kept", "covered", "n_tokens", "tokens", "lossless", "place", "part", "shard"]


def test_clashing_columns_stay_in_the_pipeline(spark):
    texts = [" ".join(f"w{i}{j}" for j in range(80)) + "\nthe same footer in all of them\n" for i in range(4)] + ["short", None]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    docs = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == wide.columns, name
        for r in docs.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES), name
    assert docs.count() >= 4 and corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_keys_called_like_results(spark):
    df = spark.createDataFrame([("a", "some text"), ("b", "other")], "size string, text string")
    assert sorted(r["size"] for r in sharding.shard(df, key="size", shards=2).collect()) == ["a", "b"]
