import random
import re

import pytest
from pyspark.sql import types as T

from quillon.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_force(rows, size):
    sets = [(k, shingle_set(t, size)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(k, len(s), find(k), find(k) == k) for k, s in sets}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((1, 2, 5, 8, 40, 200)))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(8)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(copy) // 10)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(r.choice((" ", "\n", "\t  ")).join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    texts += [None, "", " \n", "One", "one", "a b", texts[0] * 300]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, size):
    rows = corpus(size)
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")
    got = {tuple(r) for r in minhash.components(frame, shingle_words=size).collect()}
    assert got == brute_force(rows, size)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (3, text + " end"), (3, text + " end"), (9, "alone here"), (None, text), (11, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r[0] is None, r[0]) for r in minhash.drop_near_duplicates(frame).collect())
    assert left == [(False, 3), (False, 9), (False, 11), (True, None)]


def test_rows_of_one_id_have_the_links_of_each_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, "small"), (4, one), (5, "small")]
    got = {tuple(r) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert {(k, c) for k, _, c, _ in got} == {(k, 1) for k in (1, 2, 3, 4, 5)}


def test_regular_words_are_told_apart(spark):
    word = "ab"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, word)]
    got = {(r.doc_id, r.component_id) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_equal_sets_only(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f h"), (3, "A  b c d e f g")]
    got = {(r.doc_id, r.component_id) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=(100, 100)).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_long_lists_in_tiles_match_brute_force(spark):
    r, base = random.Random(4), [f"w{i}" for i in range(100)]
    rows = []
    for k in range(80):  # many that are almost similar to each other
        copy = list(base)
        for _ in range(r.randrange(14)):
            copy[r.randrange(100)] = f"z{r.randrange(1000)}"
        rows.append((k, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in minhash.components(frame, shingle_words=2, tile=7).collect()} == brute_force(rows, 2)


def test_empty_table(spark):
    frame = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert minhash.components(frame).collect() == []


def test_wanted_matches_keep_the_miss_rate():
    assert minhash.needed_matches(0.8, 32, 1e-6) == 13
    assert minhash.needed_matches(1.0, 32, 1e-6) == 32
