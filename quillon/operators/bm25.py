"""BM25 over a table of texts.

Only what the queries ask for is counted: a document's tokens are filtered to the queries' terms before they leave the
scan, so the shuffle has a row for each document and query term that it contains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.kernels import text_tokens
from quillon.sources import files

K1, B = 1.2, 0.75
#: Terms that are written into the filter; more of them are joined.
LITERAL_TERMS = 32


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toks, length) of each text; null texts have no tokens."""
    own = F.coalesce(text_tokens(text_col), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("doc_id"), own.alias("toks")).withColumn("length", F.size("toks"))


def corpus(tokenized: DataFrame) -> DataFrame:
    """One row: n_docs and the mean length, empty texts included."""
    return tokenized.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.col("length").cast("double")), F.lit(0.0)).alias("avg_length"))


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, term, times) of queries(query_id, text)."""
    return queries.select("query_id", F.explode(text_tokens(text_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _of_terms(terms: list[str]) -> Column:
    wanted = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    return F.filter("toks", lambda t: F.array_contains(wanted, t))


def frequencies(tokenized: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """(doc_id, length, term, tf) of the terms asked for."""
    if isinstance(terms, list):
        each = tokenized.select("doc_id", "length", F.explode(_of_terms(terms)).alias("term"))
    else:
        each = tokenized.select("doc_id", "length", F.explode("toks").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def scores(docs: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, matched_terms) where the score is above 0.

    Scores are rounded to ten decimals, so that ties do not depend on the order of summation. A term that a query repeats counts repeatedly; matched_terms counts distinct ones. queries has (query_id, text).
    An empty corpus and queries without terms give no rows. Ids of docs are unique. Texts are read once: what the
    queries' terms leave of them is written in the shared folder.
    """
    distinct, few = _terms(queries)
    own = tokens(docs, id_col, text_col)
    if few is not None:
        own = own.withColumn("toks", _of_terms(few))
    return scores_of(files.stored(own, "bm25"), queries, k1=k1, b=b)


def _terms(queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The terms of queries, and these as a list where they are few."""
    distinct = query_terms(queries).select("term").distinct()
    few = distinct.limit(LITERAL_TERMS + 1).collect()
    return distinct, sorted(r["term"] for r in few) if len(few) <= LITERAL_TERMS else None


def scores_of(tokenized: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """scores() of documents as tokens() gives them, best a written table: it is read for the terms, their document
    frequencies and the corpus. toks need to have the queries' terms only."""
    asked = query_terms(queries)
    distinct, few = _terms(queries)
    tf = frequencies(tokenized, distinct if few is None else few)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").crossJoin(corpus(tokenized))  # one row
    n, d = F.col("n_docs").cast("double"), F.col("df").cast("double")
    weights = weights.select("query_id", "term", "times", F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5)).alias("idf"), "avg_length")
    tf_ = F.col("tf").cast("double")
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.greatest(F.col("avg_length"), F.lit(1.0))
    part = F.col("times") * F.col("idf") * tf_ * (k1 + 1) / (tf_ + k1 * norm)
    return tf.join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 10).alias("score"), F.count("*").alias("matched_terms")).where("score > 0")


def score_of(tf: int, df: int, n_docs: int, length: int, avg_length: float, k1: float = K1, b: float = B) -> float:
    """One term's part, for tests."""
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(avg_length, 1.0)))
