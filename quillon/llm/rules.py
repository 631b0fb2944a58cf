"""Quality rules: counts of words, characters and repetitions, and gradient-boosted trees over document statistics.

Base rules are counts of whole texts. Beyond them, gradient-boosted trees learn a verdict from labelled documents:
logistic loss, histograms of at most 64 bins a statistic, leaves chosen by gain. On chosen statistics the score can only
fall (or rise) as the statistic grows. A fitted model is flattened into numpy arrays of nodes, so a batch of documents
goes down each tree level by level, all rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm._cluster import Scratch, broadcast, ship
from quillon.llm._text import hashes_of, mix, runs, utf8

#: Base rules: fewest words, and the largest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: A row is kept where its score, the modelled chance of label 1, is at least this.
LIMIT = 0.5
#: The model is fitted on so many labelled documents at most, those of the least hashes of their ids.
SAMPLE = 100_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, L2 = 60, 4, 0.15, 64, 20, 1.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see: shares of the counts, and the statistics of quality.STATISTICS.
FEATURES = ("words", "chars_a_word", "symbol_share", "dup_lines", "repeated_share", *quality.STATISTICS)
#: The score falls where these grow.
MONOTONE = {"symbol_share": -1, "dup_lines": -1, "repeated_share": -1, "repeated_lines": -1, "marks": -1, "bars": -1, "brackets": -1}

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LEADS = (np.arange(256) & 0xC0) != 0x80
_U = np.uint64


def counts(column: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text, null texts like empty ones.

    n_words: runs of characters outside space and the controls from tab to carriage return. word_chars: code points in them. n_symbols: characters of
    SYMBOLS. n_dup_lines: lines (parted by \n) with a word that equal an earlier line. n_repeat_words: words that stand in
    some three words in a row that occur twice or more in the text, by 64-bit hashes of these.
    """
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for i, j in runs(offsets):
        own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(own):
            continue
        row_of = np.repeat(np.arange(i, j), np.diff(ends))
        total = lambda flags: np.bincount(row_of[flags] - i, minlength=j - i)
        ink = ~_BLANK[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[ends] = True
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1] | edge[1:-1]
        last[:-1] &= ~ink[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        word_row = row_of[starts] - i
        out[i:j, 0] = np.bincount(word_row, minlength=j - i)
        out[i:j, 1], out[i:j, 2] = total(ink & _LEADS[own]), total(_SYMBOL[own])
        # lines, a row's own: cut after each line feed and at the ends of rows
        cut = edge.copy()
        cut[1:] |= own == 10
        line_at = np.flatnonzero(cut[:-1])
        line_end = np.append(line_at[1:], len(own))
        line_end -= own[line_end - 1] == 10
        inked = np.concatenate(([0], np.cumsum(ink)))
        some = inked[line_end] > inked[line_at]
        line_at, line_end = line_at[some], line_end[some]
        if len(line_at):
            out[i:j, 3] = _repeats(row_of[line_at] - i, hashes_of(own, line_at, line_end), j - i)
        if len(starts) > 2:
            h = hashes_of(own, starts, stops)
            three = mix(mix(mix(h[:-2]) ^ h[1:-1]) ^ h[2:])
            whole = np.flatnonzero(word_row[:-2] == word_row[2:])
            again = whole[_found_again(word_row[whole], three[whole])]
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[again + k] = True
            out[i:j, 4] = np.bincount(word_row[covered], minlength=j - i)
    return out


def _order(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by row and hash, whether each in that order equals the one before)."""
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(order), bool)
    same[1:] = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return order, same


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of each row's hashes have occurred in it before."""
    order, same = _order(rows, hashes)
    return np.bincount(rows[order][same], minlength=n)


def _found_again(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which have an equal one in the same row."""
    order, same = _order(rows, hashes)
    out = np.zeros(len(order), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def base_failed(found: np.ndarray) -> np.ndarray:
    """Which rows of COUNTS break a base rule."""
    return (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])


def features(found: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of counts and statistics."""
    words, chars = np.maximum(found[:, 0], 1), np.maximum(found[:, 1], 1)
    own = np.stack((np.log1p(found[:, 0]), found[:, 1] / words, found[:, 2] / chars, np.log1p(found[:, 3]), found[:, 4] / words), axis=1)
    return np.concatenate((own, statistics), axis=1)


@dataclass
class Trees:
    """Trees as arrays (tree, node) in heap order: statistic, edge and value. A row goes left where its statistic is at most
    the edge; a node without a split has an infinite edge, so that its rows go left to its copy below."""

    statistic: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for statistic, edge, value in zip(self.statistic, self.edge, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, statistic[node]] > edge[node])
            total += value[node]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, directions: np.ndarray | None = None, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least_rows: int = LEAST_ROWS, l2: float = L2) -> Trees:
    """Boosted trees of label y (0 or 1) by logistic loss. Labels are weighed so that both count alike.

    directions has 1, -1 or 0 for each statistic: the score never falls, never rises, or does either as it grows. A split
    on a statistic with a direction must have its sides' values in order, and their middle bounds all values below on
    either side. Without rows, or with one label only, the score is 0.5, 0 or 1 throughout.
    """
    n, width = x.shape
    directions = np.zeros(width, np.int64) if directions is None else directions
    inner = 2**depth - 1
    shape = (trees, 2 * inner + 1)
    model = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), 0.0, depth)
    share = y.mean() if n else 0.5
    if share in (0.0, 1.0) or not n:
        model.start = 0.0 if not n else 30.0 if share else -30.0
        return model
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(width)]
    cells = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    flat = cells + np.arange(width) * bins
    total = np.zeros(n)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        g, h = weight * (y - chance), weight * np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(shape[1], -np.inf), np.full(shape[1], np.inf)
        for level in range(depth + 1):
            begin, many = 2**level - 1, 2**level
            at = node - begin
            sums = [np.bincount(at, v, many) for v in (g, h)]
            value = np.clip(sums[0] / (sums[1] + l2), low[begin : begin + many], high[begin : begin + many])
            model.value[t, begin : begin + many] = value
            if level == depth:
                break
            cube = [np.bincount((at[:, None] * width * bins + flat).ravel(), np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            left, whole = [c[:, :, :-1] for c in cube], [c[:, :1, -1:] for c in cube]
            right = [w - c for w, c in zip(whole, left)]
            lo, hi = low[begin : begin + many, None, None], high[begin : begin + many, None, None]
            a, b = np.clip(left[0] / (left[1] + l2), lo, hi), np.clip(right[0] / (right[1] + l2), lo, hi)
            worth = lambda s, v: v * s[0] - (s[1] + l2) * v * v / 2
            gain = worth(left, a) + worth(right, b) - worth(whole, value[:, None, None])
            order = directions[None, :, None]
            gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows) & (order * (b - a) >= 0), gain, -np.inf)
            best = gain.reshape(many, -1).argmax(axis=1)
            statistic, cell = best // (bins - 1), best % (bins - 1)
            splits = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            for k in range(many):
                here, sides = begin + k, (2 * (begin + k) + 1, 2 * (begin + k) + 2)
                low[list(sides)], high[list(sides)] = low[here], high[here]
                if not splits[k]:
                    continue
                f = statistic[k]
                model.statistic[t, here], model.edge[t, here] = f, edges[f][cell[k]]
                if directions[f]:
                    middle = (a[k, f, cell[k]] + b[k, f, cell[k]]) / 2
                    below, above = sides if directions[f] > 0 else sides[::-1]
                    high[below], low[above] = min(high[below], middle), max(low[above], middle)
            edge_cell = np.where(splits, cell, bins)
            node = 2 * node + 1 + (cells[np.arange(n), np.where(splits, statistic, 0)[at]] > edge_cell[at])
        model.value[t] *= rate
        total += model.value[t][node]
    return model


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, counts, stats) of each row's whole text: COUNTS and FEATURES."""
    ship(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), quality._lists(found), quality._lists(features(found, quality.statistics(batch.column(1))))], names=["doc", "counts", "stats"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, "doc bigint, counts array<bigint>, stats array<double>")


def learn(described: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from the labelled documents of described(doc, counts, stats), of whole texts that break no base rule. Of more than
    ``sample`` such documents, those of the least hashes of their ids teach. Null ids and labels teach nothing."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc"), F.col(label_col).cast("double").alias("label")).where("doc is not null and label is not null")
    passed = (F.col("counts")[0] >= LEAST_WORDS) & (100 * F.col("counts")[4] <= MOST_REPEATED * F.col("counts")[0])
    found = described.where(passed).join(known, "doc").select("doc", "stats", "label", F.xxhash64("doc").alias("hash"))
    if (n := found.count()) > 2 * sample:  # the least hashes alone, so that no task gets more than a few samples
        found = found.where(F.shiftrightunsigned("hash", 34) < math.ceil((1 << 30) * 1.5 * sample / n))
    rows = found.orderBy(F.shiftrightunsigned("hash", 34), "hash", "doc", "label", "stats").limit(sample).select("stats", "label").toArrow()
    y = rows.column("label").to_numpy()
    x = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, len(FEATURES)))
    return fit(x, (y > 0).astype(np.float64), np.array([MONOTONE.get(name, 0) for name in FEATURES]))


def judge(docs: DataFrame, labels: DataFrame, *, limit: float = LIMIT, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc, *COUNTS, base_failed, score, kept) of each row of docs.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them repeated. score is what the
    trees give, which learn from labels(doc_id, quality); kept means that no base rule is broken and score is at least
    limit. Null and empty texts have zero counts, and so break the first rule; null ids and repeated rows are judged like
    any. Without labels the score is 0.5. An empty table gives no rows. Texts are read once: counts and statistics are
    written to the shared folder.
    """
    spark = docs.sparkSession
    described = Scratch(spark, "rules").table(describe(docs, id_col=id_col, text_col=text_col), "statistics")
    shared = broadcast(spark, learn(described, labels, id_col=id_col, label_col=label_col, sample=sample))  # a few hundred KB, by its trees

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = batch.column(1).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, len(COUNTS)), np.int64)
            x = batch.column(2).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, len(FEATURES)))
            score, failed = shared.value.scores(x), base_failed(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= limit))], names=["doc", *COUNTS, "base_failed", "score", "kept"])

    return described.mapInArrow(go, f"doc bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def passing(docs: DataFrame, judged: DataFrame, keep: Column | None = None) -> DataFrame:
    """The rows of docs(doc_id, ...) whose id judged() keeps, all columns as they were; rows with a null id go."""
    own = judged.where("kept" if keep is None else keep).select("doc").distinct()
    return docs.join(own, docs["doc_id"] == own["doc"], "left_semi")
