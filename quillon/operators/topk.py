"""Top-k by score, for one query or for a batch against all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, and documents in a tile that a block meets in one task.
BLOCK, TILE = 2_000, 20_000


def first_k(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best rows by score, ties by id as text. Rows without a score are left out first."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return scored.where("score is not null").orderBy(F.desc("score"), F.col(id_col).cast("string").asc()).limit(k)


def ranked(scored: DataFrame, k: int, query_col: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Per query the k best rows, with their rank from 1. Each task keeps k rows a query before the shuffle."""
    if k < 1:
        raise ValueError("k must be >= 1")
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), F.col(id_col).cast("string").asc())
    return scored.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def against_all(queries: DataFrame, docs: DataFrame, score: Callable[[], Column], k: int, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Top k of docs(doc_id, ...) for each row of queries(query_id, ...): (query_id, doc_id, score, rank).

    A block of queries is broadcast to one pass over the documents. More queries than that are dealt to blocks and the
    documents to tiles, in one plan: each pair of a block and a tile meets in one task by its numbers. score() is a
    column over both sides' columns.
    """
    n = queries.count()
    if n <= block:
        both = docs.crossJoin(F.broadcast(queries))
    else:
        blocks, tiles = -(-n // block), max(1, -(-docs.count() // tile))
        dealt = lambda c, parts: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = queries.withColumn("_block", dealt("query_id", blocks)).withColumn("_tile", every(tiles))
        right = docs.withColumn("_tile", dealt("doc_id", tiles)).withColumn("_block", every(blocks))
        both = right.join(left, ["_block", "_tile"])
    return ranked(both.select("query_id", "doc_id", score().alias("score")), k)
