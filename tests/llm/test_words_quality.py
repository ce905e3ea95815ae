import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import linededup, quality, similar, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, min_repeat=10):
    t = text or ""
    ws = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hot = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] > 1:
            hot |= {i, i + 1, i + 2}
    best = [0] * len(ws)
    for i in range(len(ws)):
        for j in range(len(ws)):
            if i != j:
                n = 0
                while i + n < len(ws) and j + n < len(ws) and ws[i + n] == ws[j + n]:
                    n += 1
                best[i] = max(best[i], n)
    cover = set()
    for i, n in enumerate(best):
        if n >= min_repeat:
            cover |= set(range(i, i + n))
    longest = max([n for n in best if n >= min_repeat], default=0)
    return [len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in t), dup, len(hot), longest, sum(len(ws[i]) for i in cover)]


def measured(texts, min_repeat=10):
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    out = quality.measure(data, offsets, min_repeat)
    return [[int(out[c][i]) for c in quality.COUNTS] for i in range(len(texts))]


def test_measure_equals_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "é# é#\né# é#\n\n", "x " * 70]
    for _ in range(60):
        bag = ["a", "b", "cé", "d#", "漢", "\n", "e\n", "f\r"][: rng.randint(2, 8)]
        texts.append(rng.choice(["", " ", "\n"]).join(" ".join(rng.choice(bag) for _ in range(rng.randint(0, 60))) for _ in range(2)))
    for least in (2, 10):
        assert measured(texts, least) == [plain(t, least) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x0b\xa0#", max_size=60), max_size=5))
def test_measure_any_text(texts):
    assert measured(texts, 2) == [plain(t, 2) for t in texts]


def test_word_hashes_and_shingles_depend_on_words_alone():
    data, offsets = words.buffers(pa.array(["one two three four five six", "  two\tthree four\nfive six", "two three", "", None]))
    scan = words.Scan(data, offsets)
    assert list(np.diff(scan.first)) == [6, 5, 2, 0, 0]
    assert list(scan.hashes[1:6]) == list(scan.hashes[6:11])
    unit, value = scan.shingles(5)
    assert list(unit) == [0, 0, 1, 2] and value[1] == value[2] and len(set(value)) == 3


def test_assess_keeps_clean_text(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    loop = " ".join(clean.split()[:40] * 8)
    rows = [(1, clean, "x"), (2, loop, "x"), (3, None, "x"), (4, "short", None), (None, clean, "x"), (1, clean, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted((str(r.doc_id), r.base_failed, r.kept) for r in quality.assess(df).collect())
    assert got == sorted([("1", False, True), ("1", False, True), ("2", True, False), ("3", True, False), ("4", True, False), ("None", False, True)])
    good = quality.keep_good(df)
    assert good.columns == df.columns and good.count() == 3
    assert quality.assess(df.limit(0)).count() == 0


def test_repeated_passages_fail_texts_that_the_base_rule_keeps(spark):
    fresh = lambda tag, k: [f"{tag}{i:05d}" for i in range(k)]
    passage, long, short = fresh("p", 70), fresh("q", 110), fresh("r", 20)
    texts = {
        1: passage + fresh("a", 90) + passage + fresh("b", 90),  # 44 % covered, longest repeat over neither floor nor share by much
        2: long + fresh("c", 400) + long + fresh("d", 380),  # 22 % covered, one repeat of 11 %
        3: short + fresh("e", 130) + short + fresh("f", 130),  # 13 % covered
    }
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: False, 3: True}
    assert got[2].covered < 0.3 and got[2].longest_repeat == 110


def test_the_last_join_of_line_dedup_does_not_sort_texts(spark):
    from weftgraph.llm import linededup

    docs = spark.createDataFrame([(i, f"a line of some words {i % 3}\nand one more of them {i}") for i in range(12)], "doc_id long, text string")
    out = linededup.clean(docs, min_words=1)
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 12


def test_word_hashes_need_no_sums_over_all_bytes():
    """Words of up to 64 bytes are hashed alone, wherever they stand; longer ones as ranges."""
    parts = ["a", "ab", "é", "abcdefgh", "abcdefghi", "abcdefgh\x00", "x" * 16, "x" * 17, "y" * 64, "abcdefghz"]
    scan = words.Scan(*words.buffers(pa.array([" ".join(parts), " " + "\t".join(reversed(parts))])))
    assert "_sums" not in vars(scan) and len(set(scan.hashes.tolist())) == len(parts)
    assert scan.hashes[: len(parts)].tolist() == scan.hashes[len(parts) :][::-1].tolist()
    long = words.Scan(*words.buffers(pa.array(["z" * 65 + " a " + "z" * 66, "a " + "z" * 65])))
    a, b, c, d, e = long.hashes.tolist()
    assert "_sums" in vars(long) and (a, b) == (e, d) and len({a, b, c}) == 3 and b == scan.hashes[0]


def test_rarity_classes_are_made_once():
    class Table:
        value = np.array([1, 2, 8], np.int32)

    table = Table()
    assert linededup._levels(table) is linededup._levels(table) and linededup._levels(table).tolist() == [0, 2, 6]


def test_sets_of_a_run_hold_each_shingle_once():
    levels = np.zeros(1 << linededup.BUCKET_BITS, np.uint64)
    texts = pa.array(["a b a b a b", "c d", "", "a b a b a b"])
    sets = linededup._Sets(np.array([7, 3, 5, 7]), texts, 2, levels)
    found = [set(x.tolist()) for x in similar.shingle_sets(texts, 2)]
    assert sets.of.tolist() == [2, 0, 1, 2] and sets.size.tolist() == [1, 0, 2]
    assert [set(sets.value[a : a + n].tolist()) for a, n in zip(sets.start, sets.size)] == [found[1], found[2], found[0]]
