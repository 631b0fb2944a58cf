import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ster", "nach", "ung", "ver"], "cc": ["é", "eau", "tre", "ment"]}


def sentence(lang, r, n=30):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def kneser_ney(text, order):
    """Interpolated Kneser-Ney probabilities by definition, from a dictionary of counts."""
    symbols = " " * (order - 1) + "".join(c if c.isalpha() else " " for c in text.lower())
    counts = {order: {}}
    for i in range(order - 1, len(symbols)):
        g = symbols[i - order + 1 : i + 1]
        counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    alphabet = len(set(symbols)) + 1

    def p(g):
        if not g:
            return 1 / alphabet
        own = counts[len(g)]
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {k: v for k, v in own.items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p


def test_probabilities_match_the_definition():
    text = sentence("bb", random.Random(1), 60)
    models = langid.train([text], ["bb"], 3)
    p = kneser_ney(text, 3)
    other = "ver nachster xu ungung"
    padded, places, _ = langid.symbols([other], 3)
    got = models.log_probabilities(padded, places)[:, 0]
    want = [math.log(p(("  " + other)[i : i + 3])) for i in range(len(other))]
    assert np.allclose(got, want, atol=1e-4)


def frame(spark, n=240):
    r = random.Random(2)
    rows = [(i, sentence(lang, r), lang, "s") for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]
    rows += [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "123 !!", "cc", "s"), (1003, sentence("aa", r), None, "s"), (None, sentence("bb", r), "bb", "s"), (5, rows[5][1], "cc", "s"), (1004, sentence("cc", r, 20_000), "cc", "s"), (1005, "ξψ" * 400, None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_held_out_accuracy_and_odd_rows(spark):
    docs, rows = frame(spark)
    models = langid.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = [tuple(r) for r in langid.predict(docs, models).collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    held = [(i, lang) for i, _, lang, _ in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(by_id[i][1] == lang for i, lang in held)
    for i in (1000, 1001, 1002):
        assert by_id[i][1:3] == ("und", 0.0) and by_id[i][4]
    assert by_id[1003][1] == "aa" and by_id[1004][1] == "cc" and by_id[None][1] == "bb"
    assert all(0 <= r[2] <= 1 for r in found)
    assert by_id[1005][4] and by_id[1005][1] in SYLLABLES  # rejected, but named by the closest
    assert not any(by_id[i][4] for i, _, _, _ in rows[:240])


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    models = langid.learn(docs)
    assert [tuple(r)[1:3] for r in langid.predict(docs, models).collect()] == [("und", 0.0)] * 2
    assert langid.predict(docs.limit(0), models).collect() == []


@pytest.mark.parametrize("texts", [[""], ["", "a", ""], ["É" * 10, "!!!"]])
def test_entropies_of_short_texts(texts):
    size, h = langid.train(["aé b", "c d"], ["x", "y"], 3).entropies(texts)
    assert len(size) == len(texts) and np.isfinite(h).all()
