"""Retrievers: lanes over DataFrames for batches of queries, and classes that answer one query.

A lane takes queries(query_id, ...) and documents(doc_id, ...) and gives (query_id, doc_id, score, rank, ...), ordered by
score with ties by id as text. Filters on documents come before scoring. The classes wrap the lanes; their search()
returns Candidates.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import filters
from quillon.functions.kernels import cosine_maxsim, cosine_to, hamming_maxsim, normalized
from quillon.operators import bm25, dense, postings, topk
from quillon.operators.records import Candidate, Filter, Query

#: Documents that the coarse stage of a staged retriever keeps.
PREFILTER = 200


# Lanes -----------------------------------------------------------------------------------------------------------------


def binary_lane(queries: DataFrame, docs: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
    """Hamming MaxSim of queries(query_id, q_bin) and docs(doc_id, bin)."""
    left = queries.select("query_id", "q_bin")
    return topk.against_all(left, filters.apply(docs, where).select("doc_id", "bin"), lambda: hamming_maxsim("q_bin", "bin").cast("double"), k)


def cosine_lane(queries: DataFrame, docs: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
    """Cosine MaxSim of queries(query_id, q_fp16) and docs(doc_id, fp16). Each token is normalized once."""
    left = queries.select("query_id", normalized("q_fp16").alias("q_unit"))
    right = filters.apply(docs, where).select("doc_id", normalized("fp16").alias("unit"))
    return dense.cosine_top(left, right, k)


def bm25_lane(queries: DataFrame, docs: DataFrame | postings.Index, k: int, where: Filter | None = None) -> DataFrame:
    """BM25 of queries(query_id, text) and docs(doc_id, text), with matched_terms. docs can be a stored index, whose blocks that
    cannot hold a hit are skipped. A filter narrows the corpus, which an index does not allow."""
    if isinstance(docs, postings.Index):
        filters.refuse(where)
        return postings.top(docs, queries, k)
    found = bm25.scores(filters.apply(docs, where), queries)
    return topk.ranked(found, k).select("query_id", "doc_id", "score", "rank", "matched_terms")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, coarse: str) -> DataFrame:
    """Cosine MaxSim of the candidates only; those without a document go. ``coarse`` names the first score's column."""
    kept = candidates.select("query_id", "doc_id", F.col("score").alias(coarse), *(c for c in candidates.columns if c == "matched_terms"))
    both = kept.join(docs.select("doc_id", "fp16"), "doc_id").join(queries.select("query_id", "q_fp16"), "query_id")
    return topk.ranked(both.withColumn("score", cosine_maxsim("q_fp16", "fp16")).drop("fp16", "q_fp16"), k)


def binary_then_cosine(queries: DataFrame, docs: DataFrame, k: int, prefilter: int = PREFILTER, where: Filter | None = None) -> DataFrame:
    return rerank(binary_lane(queries, docs, prefilter, where), queries, docs, k, "binary_score")


def bm25_then_cosine(queries: DataFrame, docs: DataFrame, k: int, prefilter: int = PREFILTER, where: Filter | None = None) -> DataFrame:
    return rerank(bm25_lane(queries, docs, prefilter, where), queries, docs, k, "bm25_score")


# Retrievers ------------------------------------------------------------------------------------------------------------


def _candidates(rows: Sequence, stage: str, debug: Sequence[str] = ()) -> list[Candidate]:
    return [Candidate(str(r["doc_id"]), float(r["score"]), stage, {name: float(r[name]) for name in debug}) for r in rows]


class Retriever:
    """What all retrievers share. docs is a DataFrame with doc_id and what the lane reads; ids are unique.

    filters: whether the retriever takes them; where it does not, a filter raises.
    """

    id = ""
    stage = ""
    needs: tuple[str, ...] = ()
    takes_filters = False

    def __init__(self, docs: DataFrame, *, allow_filters: bool | None = None):
        self.docs = docs
        if allow_filters is not None:
            self.takes_filters = allow_filters

    def size(self) -> int:
        return self.docs.count()

    def check(self, query: Query, k: int) -> None:
        for name in self.needs:
            if getattr(query, name) is None:
                raise ValueError(f"{self.id} requires query {name}")
        if k < 1:
            raise ValueError("k must be >= 1")
        if not self.takes_filters:
            filters.refuse(query.filter)

    def best(self, query: Query, k: int) -> DataFrame:
        raise NotImplementedError

    def search(self, query: Query, k: int = 10) -> list[Candidate]:
        self.check(query, k)
        return _candidates(self.best(query, k).collect(), self.stage)


class CosineRetriever(Retriever):
    """Exact cosine MaxSim over docs(doc_id, fp16); also for tables of a store."""

    id, stage, needs = "fp16-ref", "fp16_maxsim", ("fp16",)

    def best(self, query: Query, k: int) -> DataFrame:
        score = cosine_to(query.fp16, "fp16")
        return topk.first_k(filters.apply(self.docs, query.filter).select("doc_id", score.alias("score")), k)


class StoreRetriever(CosineRetriever):
    """The same over a multivector table on disk, opened when first needed."""

    id = "lance-mv"

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path = spark, path
        self._opened: DataFrame | None = None
        super().__init__(None, **options)

    @property
    def docs(self) -> DataFrame:
        if self._opened is None:
            from quillon.sources import store

            self._opened = store.read_multivectors(self.spark, self.path).withColumnRenamed("alert_id", "doc_id").withColumnRenamed("mv_fp16", "fp16")
        return self._opened

    @docs.setter
    def docs(self, value: DataFrame | None) -> None:
        self._opened = value


class BinaryRetriever(Retriever):
    """Hamming MaxSim over docs(doc_id, bin) and any columns that filters name."""

    id, stage, needs, takes_filters = "hamming-udf-bin", "binary_hamming", ("binary",), True

    def __init__(self, docs: DataFrame, *, alert_ids: Callable[[str], str] | DataFrame | None = None, **options):
        """alert_ids: where doc_id is a row id, a function from it to the alert's id, or a table (_rowid, alert_id).
        Ties are by row id; row ids that the table does not have stay."""
        super().__init__(docs, **options)
        self.alert_ids = alert_ids

    def search(self, query: Query, k: int = 10) -> list[Candidate]:
        hits = super().search(query, k)
        if self.alert_ids is None:
            return hits
        if callable(self.alert_ids):
            name = self.alert_ids
        else:
            known = self.alert_ids.where(F.col("_rowid").cast("string").isin([h.alert_id for h in hits]))
            names = {str(r["_rowid"]): r["alert_id"] for r in known.select("_rowid", "alert_id").collect()}  # at most k
            name = lambda row: names.get(row, row)
        return [replace(h, alert_id=name(h.alert_id)) for h in hits]

    def best(self, query: Query, k: int) -> DataFrame:
        score = hamming_maxsim([int(w) for w in query.binary], "bin").cast("double")
        return topk.first_k(filters.apply(self.docs, query.filter).select("doc_id", score.alias("score")), k)


class BM25Retriever(Retriever):
    """BM25 over docs(doc_id, text). The index is built once, when the first query without a filter comes."""

    id, stage, needs = "bm25", "bm25", ("text",)
    _index: postings.Index | None = None

    def best(self, query: Query, k: int) -> DataFrame:
        asked = self.docs.sparkSession.createDataFrame([("q", query.text)], "query_id string, text string")
        if query.filter is not None and not query.filter.is_noop():
            return topk.first_k(bm25.scores(filters.apply(self.docs, query.filter), asked), k)
        if self._index is None:
            self._index = postings.build(self.docs)
        return postings.top(self._index, asked, k).orderBy("rank")

    def search(self, query: Query, k: int = 10) -> list[Candidate]:
        self.check(query, k)
        return _candidates(self.best(query, k).collect(), self.stage, ("matched_terms",))


class StagedRetriever(Retriever):
    """A coarse retriever's best documents, reranked by cosine MaxSim over vectors(doc_id, fp16)."""

    coarse_score = ""

    def __init__(self, coarse: Retriever, vectors: DataFrame, *, prefilter: int = PREFILTER):
        super().__init__(vectors)
        self.coarse, self.prefilter = coarse, prefilter

    def size(self) -> int:
        return self.coarse.size()

    def check(self, query: Query, k: int) -> None:
        for name in self.needs:
            if getattr(query, name) is None:
                raise ValueError(f"{self.id} requires query {name}")
        if k < 1:
            raise ValueError("k must be >= 1")
        self.coarse.check(query, self.prefilter)

    def _reranked(self, found: DataFrame, query: Query, k: int) -> DataFrame:
        kept = found.withColumnRenamed("score", self.coarse_score)
        both = kept.join(self.docs.select("doc_id", "fp16"), "doc_id")
        return topk.first_k(both.withColumn("score", cosine_to(query.fp16, "fp16")).drop("fp16"), k)

    def best(self, query: Query, k: int) -> DataFrame:
        return self._reranked(self.coarse.best(query, self.prefilter), query, k)

    def _debug(self) -> tuple[str, ...]:
        return (self.coarse_score, *(("matched_terms",) if self.coarse.stage == "bm25" else ()))

    def search(self, query: Query, k: int = 10) -> list[Candidate]:
        self.check(query, k)
        return _candidates(self.best(query, k).collect(), self.stage, self._debug())

    def search_with_timings(self, query: Query, k: int = 10) -> tuple[list[Candidate], dict[str, float]]:
        """search(), with the milliseconds of both stages. Candidates are held between them, to time each."""
        self.check(query, k)
        began = time.perf_counter()
        found = self.coarse.best(query, self.prefilter)
        rows = found.collect()  # at most prefilter of them
        middle = time.perf_counter()
        hits: list[Candidate] = []
        if rows:
            held = self.docs.sparkSession.createDataFrame(rows, found.schema)
            hits = _candidates(self._reranked(held, query, k).collect(), self.stage, self._debug())
        ended = time.perf_counter()
        return hits, {"candidate_ms": (middle - began) * 1000, "rerank_ms": (ended - middle) * 1000 if rows else 0.0}


class BinaryThenCosine(StagedRetriever):
    id, stage, needs, coarse_score, takes_filters = "binary-then-fp16-rerank", "fp16_maxsim", ("binary", "fp16"), "binary_score", True


class HybridThenCosine(StagedRetriever):
    id, stage, needs, coarse_score = "hybrid-bm25-then-fp16-rerank", "hybrid", ("text", "fp16"), "bm25_score"
