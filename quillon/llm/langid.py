"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and read as letters, with one blank for each run of other characters. Each language has an n-gram
model of these symbols. All models are stored together: per order, one sorted array of n-gram hashes with a row of log
probabilities, one column a language, and one sorted array of context hashes with the log weights of the next lower
order. The language with the lowest cross-entropy per symbol wins. Its score is calibrated on texts left out of the
models, and so is the cross-entropy from which on a text is rejected as none of the languages.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._cluster import broadcast, ship
from quillon.llm._text import mix

ORDER = 4
#: Bounds of what is learned from: documents and characters a language. Longer texts than a tenth are not used.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 2_000_000
#: Share of the sample that is left out of the models and calibrates scores and rejection.
LEFT_OUT = 0.25
#: Standard deviations above a language's usual cross-entropy from which on a text is rejected.
REJECT = 8.0
#: Cross-entropies may differ by so much, in nats a symbol, before texts of a language count as unusual at all.
SLACK = 1.0
RUN_CHARS = 1 << 19

_BLANK = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def symbols(texts: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded symbols, places of the real ones, bounds of each text among these). Texts without a letter have none."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    letter = _is_letter()[codes]
    starts = np.zeros(len(codes) + 1, bool)
    starts[ends] = True
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1] & ~starts[1:-1]
    keep = letter | after
    bounds = np.concatenate(([0], np.cumsum(keep)))[ends]
    kept = np.compress(keep, np.where(letter, codes, _BLANK)).astype(np.uint64)
    text = np.repeat(np.arange(len(low)), np.diff(bounds))
    places = np.arange(len(kept)) + (order - 1) * (text + 1)
    padded = np.full(len(kept) + (order - 1) * (len(low) + 1), np.uint64(_BLANK))
    padded[places] = kept
    return padded, places, bounds


def grams(padded: np.ndarray, places: np.ndarray, n: int, last: int = 0) -> np.ndarray:
    """Hashes of the n symbols that end ``last`` places before each of places."""
    h = np.full(len(places), np.uint64(n))
    for j in range(n - 1, -1, -1):
        h = h * _MULTIPLIER + padded[places - (j + last)] + np.uint64(1)
    return mix(h)


@dataclass
class Models:
    """All languages' models. keys[n], logs[n]: n-grams; contexts[n], weights[n]: contexts of n symbols."""

    languages: list[str]
    order: int
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    floor: np.ndarray
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    sharpness: float = 1.0

    def log_probabilities(self, padded: np.ndarray, places: np.ndarray, order: int | None = None) -> np.ndarray:
        """Per place and language, the log probability of its symbol after those before it."""
        n = self.order if order is None else order
        if not n:
            return np.broadcast_to(self.floor, (len(places), len(self.languages)))
        wanted = grams(padded, places, n)
        at = np.searchsorted(self.keys[n], wanted)
        at[at == len(self.keys[n])] = 0
        known = self.keys[n][at] == wanted if len(self.keys[n]) else np.zeros(len(wanted), bool)
        out = np.empty((len(places), len(self.languages)), np.float32)
        out[known] = self.logs[n][at[known]]
        if not known.all():
            rest = places[~known]
            lower = self.log_probabilities(padded, rest, n - 1)
            context = grams(padded, rest, n - 1, 1)
            at = np.searchsorted(self.contexts[n - 1], context)
            at[at == len(self.contexts[n - 1])] = 0
            seen = self.contexts[n - 1][at] == context if len(self.contexts[n - 1]) else np.zeros(len(context), bool)
            out[~known] = lower + np.where(seen[:, None], self.weights[n - 1][at] if len(self.contexts[n - 1]) else 0, 0)
        return out

    def entropies(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of each text, cross-entropy per symbol by text and language in nats; 0 for texts without letters)."""
        padded, places, bounds = symbols(texts, self.order)
        sums = np.zeros((len(texts), len(self.languages)))
        size = np.diff(bounds)
        for k in range(0, len(places), RUN_CHARS):
            logs = self.log_probabilities(padded, places[k : k + RUN_CHARS]).astype(np.float64)
            first = int(np.searchsorted(bounds, k, "right")) - 1
            last = int(np.searchsorted(bounds, min(k + RUN_CHARS, len(places)), "left"))
            own = np.arange(first, last)
            own = own[size[own] > 0]
            cut = np.maximum(bounds[own] - k, 0)
            sums[own] += np.add.reduceat(logs, cut, axis=0)
        return size, -sums / np.maximum(size, 1)[:, None]


def train(texts: Sequence[str], languages: Sequence[str], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney models of each language's texts, one discount per order."""
    names = sorted(set(languages))
    raw: list[dict[int, tuple]] = []
    alphabet = 2
    for name in names:
        padded, places, _ = symbols([t for t, lang in zip(texts, languages) if lang == name], order)
        alphabet = max(alphabet, len(np.unique(padded)) + 1)
        found: dict[int, tuple] = {}
        long_ids = None
        for n in range(order, 0, -1):
            hashes = grams(padded, places, n)
            if n == order:
                keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            else:  # how many symbols stand before it: one for each distinct gram that is longer by one
                keys, first, counts = np.unique(hashes[long_ids], return_index=True, return_counts=True)
                first = long_ids[first]
            context = grams(padded, places[first], n - 1, 1) if n > 1 else np.zeros(len(keys), np.uint64)
            shorter = grams(padded, places[first], n - 1) if n > 1 else np.zeros(len(keys), np.uint64)
            found[n] = (keys, counts.astype(np.float64), context, shorter, padded, places[first])
            long_ids = np.sort(first)
        raw.append(found)
    floor = np.full(len(names), -np.log(alphabet))
    models = Models(names, order, {}, {}, {}, {}, floor)
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([r[n][0] for r in raw])) if raw else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([r[n][2] for r in raw])) if raw else np.zeros(0, np.uint64)
        context_of, lower = np.zeros(len(keys), np.int64), np.zeros((len(keys), len(names)))
        for r in raw:
            k, _, c, _, padded, at = r[n]
            row = np.searchsorted(keys, k)
            context_of[row] = np.searchsorted(contexts, c)
            lower[row] = models.log_probabilities(padded, at, n - 1)
        weight = np.ones((len(contexts), len(names)))
        direct = np.zeros((len(keys), len(names)))
        for j, r in enumerate(raw):
            k, counts, c, _, _, _ = r[n]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            ctx = np.searchsorted(contexts, c)
            total = np.bincount(ctx, counts, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            seen = total > 0
            weight[seen, j] = discount * kinds[seen] / total[seen]
            direct[np.searchsorted(keys, k), j] = np.maximum(counts - discount, 0) / total[ctx]
        models.keys[n], models.contexts[n - 1] = keys, contexts
        models.weights[n - 1] = np.log(weight).astype(np.float32)
        models.logs[n] = np.log(np.maximum(direct + weight[context_of] * np.exp(lower), 1e-30)).astype(np.float32)
    return models


def calibrate(models: Models, texts: Sequence[str], languages: Sequence[str]) -> Models:
    """Set the usual cross-entropy and spread of each language, and the sharpness of scores, from texts not trained on."""
    size, h = models.entropies(texts)
    truth = np.array([models.languages.index(x) for x in languages], dtype=np.int64)
    models.usual, models.spread = np.full(len(models.languages), np.inf), np.ones(len(models.languages))
    for j in range(len(models.languages)):
        own = (truth == j) & (size > 0)
        if own.any():
            models.usual[j] = np.average(h[own, j], weights=size[own])
            models.spread[j] = np.sqrt(np.average((h[own, j] - models.usual[j]) ** 2 * size[own]))  # of one symbol
    letters = size > 0
    if letters.any():
        def loss(s: float) -> float:
            return -float(np.mean(np.log(np.maximum(_shares(h[letters], size[letters], s)[np.arange(letters.sum()), truth[letters]], 1e-9))))

        models.sharpness = min((2.0**-k for k in range(12)), key=loss)
    return models


def _shares(h: np.ndarray, size: np.ndarray, sharpness: float) -> np.ndarray:
    x = -h * (size * sharpness)[:, None]
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def judge(models: Models, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language or und, score, cross-entropy, rejected) of each text; ties go to the first language by name."""
    size, h = models.entropies(texts)
    none = size == 0
    if not models.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    best = h.argmin(axis=1)
    rows = np.arange(len(texts))
    score = _shares(h, size, models.sharpness)[rows, best]
    limit = models.usual[best] + SLACK + REJECT * models.spread[best] / np.sqrt(np.maximum(size, 1))
    return ["und" if x else models.languages[b] for x, b in zip(none, best)], np.where(none, 0.0, score), np.where(none, 0.0, h[rows, best]), none | (h[rows, best] > limit)


def learn(docs: DataFrame, allowed: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models of the values of lang_col, from a bounded sample of whole texts of the rows that ``allowed`` admits.

    Per language the sample is the first documents in the order of a hash of the id, at most sample_docs of them with
    sample_chars characters. Rows with a null language or text teach nothing; without any row there are no languages.
    """
    rows = docs if allowed is None else docs.where(allowed)
    rows = rows.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.withColumn("size", F.length("text")).where(F.col("size").between(1, sample_chars // 10)).withColumn("place", F.xxhash64(F.col("doc").cast("string")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [], order)
    # a few times as many rows as wanted, so that ordering them is cheap
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4.0 * sample_docs / n)))))
    near = rows.where(F.pmod("place", F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    order_by = Window.partitionBy("lang").orderBy("place", "doc", "text")
    picked = near.withColumn("k", F.row_number().over(order_by)).where(F.col("k") <= sample_docs).withColumn("chars", F.sum("size").over(order_by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("chars") <= sample_chars)
    ship(docs.sparkSession)
    # the sample is bounded, and learned from in one task, so that neither it nor the training is on the driver
    made = picked.select("lang", "k", "text").repartition(1).mapInArrow(lambda batches: _learned(batches, order), "models binary").collect()
    return pickle.loads(made[0]["models"]) if made else train([], [], order)


def _learned(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """The pickled models of a sample (lang, k, text), of which a part is left out for calibration."""
    sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    if not sample:
        return
    every = round(1 / LEFT_OUT)
    left_out = [(t, lang) for lang, k, t in sample if k % every == 0] or [(t, lang) for lang, _, t in sample]
    rest = [(t, lang) for lang, k, t in sample if k % every] or left_out
    models = train([t for t, _ in rest], [lang for _, lang in rest], order)
    known = [(t, lang) for t, lang in left_out if lang in models.languages]
    models = calibrate(models, [t for t, _ in known], [lang for _, lang in known])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(models)], pa.binary())], names=["models"])


def predict(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, entropy, rejected) of each row's whole text.

    lang_pred is a learned language, or ``und`` where the text is null, empty or has no letter; these have score 0 and
    are rejected. score is the calibrated share of the language among all; rejected marks texts whose cross-entropy lies
    far above that of the language's own texts. Null ids and repeated rows are judged like any; no rows give none.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast(spark, models)  # bounded by the sample that it was learned from

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            texts, chars = [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py() or "")
                chars += len(texts[-1])
                if chars >= RUN_CHARS or i + 1 == batch.num_rows:
                    parts.append(judge(shared.value, texts))
                    texts, chars = [], 0
            if parts:
                lang = pa.array([x for p in parts for x in p[0]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), lang, *(pa.array(np.concatenate([p[k] for p in parts])) for k in (1, 2, 3))], names=["doc", "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc bigint, lang_pred string, score double, entropy double, rejected boolean")


def keep_known(docs: DataFrame, models: Models, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text predict() does not reject, with all columns. Texts do not leave their partition.

    Null and empty texts and texts without letters go, as do all where no language was learned. Rows with null ids and
    repeated rows are judged like any; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = broadcast(spark, models)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            texts, chars = [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(at)[i].as_py() or "")
                chars += len(texts[-1])
                if chars >= RUN_CHARS or i + 1 == batch.num_rows:
                    yield batch.slice(first, len(texts)).filter(pa.array(~judge(shared.value, texts)[3]))
                    first, texts, chars = i + 1, [], 0

    return docs.mapInArrow(keep, docs.schema)
