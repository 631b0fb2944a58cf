"""A quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration.

Each document becomes a fixed number of statistics of its whole text. Their random Fourier features approximate a
Gaussian kernel. Partitions sum up the normal equations of the labelled rows, which are added up and solved once; the
ridge scores are then calibrated by isotonic regression over a histogram of fixed bins, on labelled rows left out before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, broadcast, ship
from quillon.llm._text import runs, utf8, words

FEATURES = 256
RIDGE = 1e-3
BINS = 1000
SEED = 20
#: One labelled document in so many, by a hash of its id, is left out of the regression and calibrates it.
CALIBRATE = 5

#: The statistics, in their order.
STATISTICS = (
    "bytes", "words", "word_length", "word_length_spread", "upper", "digits", "blanks", "lines", "stops", "commas", "exclamations", "marks", "bars", "brackets",
    "non_ascii", "distinct_words", "short_words", "long_words", "upper_words", "bare_words", "top_word", "entropy", "line_spread", "repeated_lines",
)

_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "blanks": (9, 11, 12, 13, 32), "lines": (10,), "stops": b".?", "commas": b",;:", "exclamations": b"!", "marks": b"#$%&*@^~=+", "bars": b"|", "brackets": b"<>{}[]()\\/_", "non_ascii": range(128, 256)}
_TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; null and empty texts have zeros."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(STATISTICS)))
    at = {name: k for k, name in enumerate(STATISTICS)}
    for i, j in runs(offsets):
        own = data[offsets[i] : offsets[j]]
        ends = offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(ends), 1)
        block = out[i:j]
        block[:, at["bytes"]] = np.log1p(np.diff(ends))
        for name, table in _TABLES.items():
            block[:, at[name]] = np.diff(np.concatenate(([0], np.cumsum(table[own])))[ends]) / size
        starts, stops, hashes, bounds = words(data, offsets[i : j + 1])
        length = (stops - starts).astype(np.float64)
        n = np.diff(bounds)
        many = np.maximum(n, 1)
        total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[bounds])
        block[:, at["words"]] = np.log1p(n)
        block[:, at["word_length"]] = mean = total(length) / many
        block[:, at["word_length_spread"]] = np.sqrt(np.maximum(total(length**2) / many - mean**2, 0))
        block[:, at["short_words"]] = total(length <= 3) / many
        block[:, at["long_words"]] = total(length >= 12) / many
        first, last = own[starts], own[stops - 1]
        block[:, at["upper_words"]] = total(_TABLES["upper"][first] & (_TABLES["upper"][own[np.minimum(starts + 1, stops - 1)]])) / many
        block[:, at["bare_words"]] = total(_ALNUM[last]) / many
        line = np.concatenate(([0], np.cumsum(own == 10)))
        for k in range(j - i):
            mine = np.sort(hashes[bounds[k] : bounds[k + 1]])
            if not len(mine):
                continue
            edge = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1], [True])))
            block[k, at["distinct_words"]] = (len(edge) - 1) / len(mine)
            block[k, at["top_word"]] = np.diff(edge).max() / len(mine)
            shares = np.bincount(own[ends[k] : ends[k + 1]], minlength=256) / size[k]
            shares = shares[shares > 0]
            block[k, at["entropy"]] = -(shares * np.log(shares)).sum()
            if line[ends[k + 1]] > line[ends[k]]:
                lines = own[ends[k] : ends[k + 1]].tobytes().split(b"\n")
                sizes = np.array([len(x) for x in lines])
                block[k, at["line_spread"]] = sizes.std() / max(sizes.mean(), 1)
                block[k, at["repeated_lines"]] = 1 - len(set(lines)) / len(lines)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, stats) of each row's whole text."""
    ship(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(statistics(batch.column(1)))], names=["doc", "stats"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, "doc bigint, stats array<double>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(x), 1)), x, np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model of label (0 or 1) from all rows of labelled(stats, label, left_out): the rows left out calibrate what the
    others teach. Where there are none of either, all rows do both; without any the score is 0.5 throughout."""
    width = len(STATISTICS)
    sides = {r["left_out"]: r["n"] for r in labelled.groupBy("left_out").agg(F.count("*").alias("n")).collect()}
    held, labelled = (labelled.where("left_out"), labelled.where("not left_out")) if len(sides) == 2 else (labelled, labelled)
    moments = labelled.agg(F.count("*").alias("n"), *(f(F.col("stats")[k] if f is F.avg else F.col("stats")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    r = np.random.default_rng(seed)
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([moments[f"s{k}"] or 0.0 for k in range(width)])
    directions = r.normal(size=(width, features)) / np.sqrt(width)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, r.uniform(0, 2 * np.pi, features), np.zeros(1 + width + features), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not moments["n"]:
        return model
    size = len(model.weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            stats, y = _vectors(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for k in range(0, len(y), 4096):
                z = model.features(stats[k : k + 4096])
                a += z.T @ z
                b += z.T @ y[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((a.reshape(-1), b)).tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = labelled.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(sums, "sums binary")
    total = sum(np.frombuffer(x["sums"]) for x in parts.repartition(8).mapInArrow(added, "sums binary").collect())
    a, b = total[: size * size].reshape(size, size), total[size * size :]
    model.weights = np.linalg.solve(a + ridge * moments["n"] * np.eye(size), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_vectors(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 0.5) / 2 * (BINS - 1)).astype(np.int64)), batch.column(1)], names=["bin", "label"])

    rows = held.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(binned, "bin bigint, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()
    weight = np.array([x["n"] for x in rows], np.float64)
    model.edges = (np.array([x["bin"] for x in rows]) + 0.5) * 2 / (BINS - 1) - 0.5
    model.levels = np.clip(isotonic(np.array([x["y"] for x in rows]), weight), 0.0, 1.0)
    return model


def score(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc, score, predicted) for each row of docs, from the labels of the rows whose id ``allowed``(doc) admits.

    ``allowed`` is a condition on a column named doc. score, from 0 to 1, is the calibrated share of label 1; predicted
    is 1 from 0.5 on. Null, empty and blank texts are scored by their statistics, which are zeros. Rows with a null id
    are scored but teach nothing, as do labels that are null or without a document; a document labelled repeatedly
    counts once for each label. No labels give 0.5 throughout, an empty table no rows. Statistics are written to the
    shared folder once, so texts are read once.
    """
    spark = docs.sparkSession
    described = Scratch(spark, "quality").table(describe(docs, id_col=id_col, text_col=text_col), "statistics")
    known = labels.select(F.col(id_col).cast("bigint").alias("doc"), F.col(label_col).cast("double").alias("label")).where("label is not null").where(allowed)
    model = fit(described.join(known, "doc").select("stats", "label", (F.pmod(F.xxhash64("doc"), F.lit(CALIBRATE)) == 0).alias("left_out")))
    shared = broadcast(spark, model)  # its size is fixed by the number of statistics, features and bins

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _vectors(batch.column(1))
            found = np.concatenate([shared.value.scores(stats[k : k + 4096]) for k in range(0, len(stats), 4096)]) if len(stats) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc", "score", "predicted"])

    return described.mapInArrow(go, "doc bigint, score double, predicted int")
