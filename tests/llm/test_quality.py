import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(5, 80))]
        bad = i % 4 == 0
        out.append((i, (" | " if bad else " ").join(ws) + ("" if bad else "."), 0 if bad else 1))
    return out


def test_held_out_accuracy(spark):
    rows = texts(1, 600)
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(9000, None, "c"), (9001, "", "c"), (None, "no id", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(9000, None), (None, 1), (77_777, 1)], "doc_id long, quality int")
    out = {r[0]: r for r in quality.score(docs, labels, F.col("doc") % 3 != 1).collect()}
    held = [(out[i].predicted, q) for i, _, q in rows if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[9000].score == out[9001].score


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r)[1:] for r in quality.score(docs, labels, F.lit(True)).collect()] == [(0.5, 1)] * 2
    assert quality.score(docs.limit(0), labels, F.lit(True)).collect() == []


def test_fit_matches_the_normal_equations(spark):
    import pyarrow as pa

    rows = texts(7, 300)
    stats = quality.statistics(pa.array([t for _, t, _ in rows]))
    y = np.array([q for *_, q in rows], float)
    out = np.arange(len(rows)) % 4 == 0
    frame = spark.createDataFrame([(s.tolist(), float(q), bool(o)) for s, q, o in zip(stats, y, out)], "stats array<double>, label double, left_out boolean").repartition(5)
    model = quality.fit(frame, features=40)
    assert np.allclose(model.mean, stats[~out].mean(axis=0)) and np.allclose(model.scale, np.where(stats[~out].std(axis=0) > 1e-9, stats[~out].std(axis=0), 1))
    z = model.features(stats[~out])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y[~out]), atol=1e-6)
    bins = np.floor((np.clip(model.raw(stats[out]), -0.5, 1.5) + 0.5) / 2 * (quality.BINS - 1)).astype(int)
    own = np.unique(bins)
    levels = quality.isotonic(np.array([y[out][bins == b].mean() for b in own]), np.array([(bins == b).sum() for b in own], float))
    assert np.allclose(model.edges, (own + 0.5) * 2 / (quality.BINS - 1) - 0.5) and np.allclose(model.levels, levels)


def test_isotonic_regression_by_brute_force():
    r = random.Random(3)
    for _ in range(50):
        y = np.array([r.random() for _ in range(r.randrange(1, 9))])
        w = np.array([r.randrange(1, 5) for _ in y], float)
        got = quality.isotonic(y, w)
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
        assert np.allclose(got, [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]) and np.allclose(got, want)


def test_statistics_do_not_depend_on_the_neighbours():
    import pyarrow as pa

    rows = [t for _, t, _ in texts(4, 20)] + [None, "", "x" * 3_000_000, "a\nb\na"]
    whole = quality.statistics(pa.array(rows))
    for i, t in enumerate(rows):
        assert np.allclose(quality.statistics(pa.array([t], pa.string())), whole[i])
