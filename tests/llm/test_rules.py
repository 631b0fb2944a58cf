import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import queries, rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def plain(text):
    """The counts of a text in plain Python."""
    text = text or ""
    words, seen, repeated, windows = WORDS(text), set(), 0, {}
    for line in text.split("\n"):
        if WORDS(line):
            repeated += line in seen
            seen.add(line)
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)]


ODD = [
    None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "a b c a b c", "a b c\na b c\n\n \na b c", "x\r\nx\r\nx", "# * $%&|<>", "é ü ñ 漢字 \U0001f600", "a\n\n\na", "A b c a b c", "line \nline",
    "\nx\nx", "w " * 5000, "ab cd ef\nab cd\nef ab cd ef", "tail\n", "\x0bx\x0cx\x0b",
]


def test_counts_of_odd_texts():
    r = random.Random(1)
    texts = ODD + ["".join(r.choices(["a", "b", "cc", " ", " ", "\n", "\t", "#", "é"], k=r.randrange(200))) for _ in range(300)]
    assert rules.counts(pa.array(texts, pa.string())).tolist() == [plain(t) for t in texts]
    assert rules.counts(pa.array(texts, pa.string()).slice(3, 40)).tolist() == [plain(t) for t in texts[3:43]]


def test_runs_do_not_change_counts(monkeypatch):
    from quillon.llm import _text

    monkeypatch.setattr(_text, "RUN_BYTES", 7)
    monkeypatch.setattr(rules, "runs", lambda offsets: _text.runs(offsets, 7))
    assert rules.counts(pa.array(ODD, pa.string())).tolist() == [plain(t) for t in ODD]


def walked(model, x):
    """Scores of one row after the other, node by node."""
    out = []
    for row in x:
        total = model.start
        for statistic, edge, value in zip(model.statistic, model.edge, model.value):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[statistic[node]] > edge[node] else 1)
            total += value[node]
        out.append(1 / (1 + math.exp(-max(-30, min(30, total)))))
    return out


def test_trees_learn_and_keep_directions():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 4))
    y = (x[:, 0] - np.sin(3 * x[:, 1]) + 0.3 * r.normal(size=3000) > 0).astype(float)
    directions = np.array([1, 0, -1, 0])
    model = rules.fit(x[:2000], y[:2000], directions)
    assert np.mean((model.scores(x[2000:]) >= 0.5) == y[2000:]) > 0.85
    assert np.allclose(model.scores(x[:50]), walked(model, x[:50]))
    for k in (0, 2):
        line = np.repeat(r.normal(size=(40, 1, 4)), 60, axis=1)
        line[:, :, k] = np.linspace(-4, 4, 60)
        steps = np.diff(model.raw(line.reshape(-1, 4)).reshape(40, 60), axis=1) * directions[k]
        assert steps.min() >= -1e-12
    free = rules.fit(x[:2000], y[:2000])
    assert np.abs(free.raw(x) - model.raw(x)).max() > 0


def test_one_split_is_the_best_of_all():
    """One tree of depth one against every split by brute force."""
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(200, 3)), 1)
    y = (x[:, 1] > 0.2).astype(float)
    model = rules.fit(x, y, trees=1, depth=1, bins=200, least_rows=1)
    assert model.statistic[0, 0] == 1 and model.edge[0, 0] == max(v for v in x[:, 1] if v <= 0.2)


def test_fits_without_rows_or_one_label():
    none = rules.fit(np.zeros((0, 2)), np.zeros(0))
    assert none.scores(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert (rules.fit(np.ones((5, 2)), np.ones(5)).scores(np.zeros((2, 2))) > 0.99).all()
    assert (rules.fit(np.ones((5, 2)), np.zeros(5)).scores(np.zeros((2, 2))) < 0.01).all()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    return [(i, (" | " if i % 4 == 0 else " ").join(word() for _ in range(r.randrange(60, 90))), int(i % 4 > 0)) for i in range(400)]


def test_judge(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(900, None, "x", 1), (901, "few words", "x", 1), (None, rows[1][1], "x", 1), (1, rows[1][1], "x", 1), (902, "same three words " * 40, "x", 1)], "doc_id long, text string, kept string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(900, 1), (None, 0), (7, None), (12345, 0)], "doc_id long, quality int")
    got = rules.judge(docs, labels).collect()
    assert len(got) == len(rows) + 5
    texts = {i: t for i, t, _ in rows}
    for r in got:
        own = plain(texts.get(r.doc, {None: rows[1][1], 900: None, 901: "few words", 902: "same three words " * 40}.get(r.doc)))
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        assert [r[c] for c in rules.COUNTS] == own and r.base_failed == failed and r.kept == (not failed and r.score >= 0.5)
    assert {r.doc: r.kept for r in got if r.doc in texts} == {i: bool(q) for i, _, q in rows}
    kept = rules.passing(docs, rules.judge(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(q for _, _, q in rows) + 1
    assert rules.judge(docs.limit(0), labels).collect() == []
    assert {r.score for r in rules.judge(docs, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_bounded_and_deterministic(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    described = rules.describe(docs)
    a, b = rules.learn(described, labels, sample=100), rules.learn(described.repartition(3), labels, sample=100)
    assert np.array_equal(a.value, b.value) and not np.array_equal(a.value, rules.learn(described, labels).value)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_quality_rules(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert [r[c] for c in rules.COUNTS] == plain(texts[k]) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept is False if r.base_failed else isinstance(r.kept, bool))
    labels = [(got[r.doc_id].kept, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality is not None and not got[r.doc_id].base_failed]
    assert sum(bool(q) == k for k, q in labels) >= 0.9 * len(labels)
