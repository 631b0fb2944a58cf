"""Standing queries: each keeps its best documents in state while documents stream in, with expiry.

A batch of documents is scored against all standing queries where it is read. A task passes on no more than can still
matter, and a query's state holds no more either: of documents with a time, those that fewer than k others beat in score
and outlive. So after any order of batches the result is that of a batch search over the documents that have not
expired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.sources import files

#: The state store that transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "query_id string, doc_id string, score double, at double, latest double"
#: What a query's latest batch found: its k best documents now, with the greatest time that it has seen.
RESULT = "query_id string, doc_id string, score double, rank int, latest double"


def still_needed(rows: list[tuple[str, float, float]], k: int, keep: float | None) -> list[tuple[str, float, float]]:
    """Of (doc_id, score, at) those that can be among the k best now or later, best first: fewer than k documents come before
    them by score, ties by id, and live at least as long. Without expiry that is the k best. A document that comes again
    counts once, as it came last; of equal times with the greater score."""
    own: dict[str, tuple[float, float]] = {}
    for doc, score, at in rows:
        own[doc] = max(own.get(doc, (at, score)), (at, score))
    ordered = sorted(((doc, score, at) for doc, (at, score) in own.items()), key=lambda r: (-r[1], r[0]))
    if keep is None:
        return ordered[:k]
    out: list[tuple[str, float, float]] = []
    times: list[float] = []
    for doc, score, at in ordered:
        if sum(t >= at for t in times) < k:
            out.append((doc, score, at))
            times.append(at)
    return out


class _Best(StatefulProcessor):
    """A query's documents as three arrays, and the greatest time it has seen."""

    def __init__(self, k: int, keep: float | None):
        self.k, self.keep = k, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "docs array<string>, scores array<double>, times array<double>, latest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, float, float]] = []
        latest = None
        if self.state.exists():
            docs, scores, times, latest = self.state.get()
            held = list(zip(docs, scores, times))
        for batch in rows:
            times = batch["latest"].max()
            latest = float(times) if latest is None else max(latest, float(times))
            real = batch[batch["doc_id"].notna()]
            held = still_needed([*held, *zip(real["doc_id"], real["score"].astype(float), real["at"].astype(float))], self.k, self.keep)
        if self.keep is not None:
            held = [r for r in held if r[2] > latest - self.keep]
        self.state.update(([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], latest))
        best = held[: self.k] or [(None, None, None)]  # says that nothing is left
        ranks = range(1, len(best) + 1) if held else [0]
        yield pd.DataFrame({"query_id": [key[0]] * len(best), "doc_id": [r[0] for r in best], "score": [r[1] for r in best], "rank": pd.array(ranks, "int32"), "latest": [latest] * len(best)})

    def close(self) -> None:
        pass


def standing(docs: DataFrame, queries: DataFrame, score: Callable[[], Column], k: int, *, time_col: str | None = None, keep_seconds: float | None = None) -> DataFrame:
    """A stream of RESULT rows: after each batch of the stream docs(doc_id, ...), the k best documents so far of each of
    queries(query_id, ...), a table of a bounded number of standing queries.

    score() is a column over both sides' columns; documents without a score count nowhere. With keep_seconds, documents
    expire when their time_col (a timestamp) lies that far behind the greatest one seen, late ones included; those without
    a time count nowhere. The rows of a query replace all of its earlier ones; a query that has nothing left gives one row
    of rank 0, without a document. Write the stream in update mode; the session's state store must be STORE.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if (time_col is None) != (keep_seconds is None):
        raise ValueError("time_col and keep_seconds go together")
    files.ship(queries.sparkSession)
    at = F.col(time_col).cast("double") if time_col else F.lit(0.0)
    scored = docs.crossJoin(F.broadcast(queries)).select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), score().cast("double").alias("score"), at.alias("at"))

    def fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, own in batch[batch["at"].notna()].groupby("query_id", sort=False):
                real = own[own["score"].notna()]
                held = still_needed(list(zip(real["doc_id"], real["score"], real["at"])), k, keep_seconds)
                latest = float(own["at"].max())
                out += [(query, *r, latest) for r in held] or [(query, None, None, None, latest)]
            yield pd.DataFrame(out, columns=["query_id", "doc_id", "score", "at", "latest"])

    near = scored.mapInPandas(fewer, _ROW)
    return near.groupBy("query_id").transformWithStateInPandas(_Best(k, keep_seconds), RESULT, "update", "none")


def latest(emitted: DataFrame) -> DataFrame:
    """The current result from all rows that a stream has written, with the number of their batch as ``batch_id``."""
    last = emitted.groupBy("query_id").agg(F.max("batch_id").alias("batch_id"))
    return emitted.join(last, ["query_id", "batch_id"]).where(F.col("rank") > 0).drop("batch_id")
