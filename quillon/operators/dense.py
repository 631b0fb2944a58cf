"""Top-k by cosine MaxSim for a batch of queries against all documents, by matrix products of a block and a tile.

Products in single precision say which documents of a tile can be among a query's k best, with a bound on their error; the
scores of these are computed anew in double precision, in the order of kernels.cosine_maxsim(), so that scores and ties are
those of that expression. Copies in a tile are scored once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.kernels import cosine_maxsim
from quillon.operators import topk
from quillon.sources import files

#: Queries in a block, and documents in a tile at most; a tile has LEAST at least where cores would be idle.
BLOCK, TILE, LEAST = 2_000, 4_096, 256
#: Pairs that are scored in double precision at once, and rows that are ranked at once.
PAIRS, ROWS = 1_000, 4_000_000
#: Rounding of single precision, doubled.
ROUNDING = 1.2e-7


def _odd(tokens: str) -> Column:
    """Whether a token or number is missing or not a number, or tokens are not of one width."""
    bad = lambda v: v.isNull() | (F.size(v) != F.size(F.element_at(tokens, 1))) | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(F.exists(tokens, lambda v: F.coalesce(bad(v), F.lit(True))), F.lit(False))


def _padded(column: pa.ChunkedArray, width: int, repeat: bool) -> np.ndarray:
    """(rows, tokens, width), rows of fewer tokens filled up with zeros, or with their first token where they have one."""
    own = column.combine_chunks()
    sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0))), width))
    row, begins = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    out[row, np.arange(len(row)) - np.repeat(begins, sizes)] = own.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(row), width)
    if repeat:
        out = np.where((np.arange(out.shape[1])[None, :] < sizes[:, None])[:, :, None], out, out[:, :1])
    return out


def _widths(column: pa.ChunkedArray) -> set[int]:
    return set(column.combine_chunks().flatten().value_lengths().unique().to_pylist())


def _scores(queries: np.ndarray, docs: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of pairs of rows by number, added up from the first number on, as the expression does."""
    found = np.zeros(len(q))
    for k in range(0, len(q), PAIRS):
        left, right = queries[q[k : k + PAIRS]], docs[d[k : k + PAIRS]]
        each = np.cumsum(left[:, :, None, :] * right[:, None, :, :], axis=3)[..., -1].max(axis=2)
        for t in range(each.shape[1]):
            found[k : k + PAIRS] += each[:, t]
    return found


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = (left.schema.field("query_id").type, right.schema.field("doc_id").type, pa.float64())
        names = ["query_id", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        asked, stand = _widths(left["q_unit"]), _widths(right["unit"])
        if asked and stand and len(asked | stand) > 1:
            raise ValueError("query and document dimensions differ")
        width = max(asked | stand, default=1)
        queries, tokens = _padded(left["q_unit"], max(width, 1), False), _padded(right["unit"], max(width, 1), True)
        # members of each distinct document by the text of their ids
        text = right["text"].to_pylist()
        place = np.empty(len(text), np.int64)
        place[sorted(range(len(text)), key=lambda i: (text[i] is not None, text[i] or ""))] = np.arange(len(text))
        flat = np.ascontiguousarray(tokens + 0.0).reshape(len(tokens), -1)
        _, first, same = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        docs, members = tokens[first], np.lexsort((place, same))
        begins = np.searchsorted(same[members], np.arange(len(first)))
        copies = np.minimum(np.diff(np.append(begins, len(members))), k)
        single, slack = docs.astype(np.float32), 2 * ROUNDING * (width + 4) * queries.shape[1]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slab = max(1, ROWS // (k * k + len(first)))
        for at in range(0, len(queries), slab):
            own = queries[at : at + slab]
            near = np.zeros((len(own), len(first)), np.float32)
            for s in range(own.shape[1]):
                asking = own[:, s].astype(np.float32)
                top = asking @ single[:, 0].T
                for t in range(1, single.shape[1]):
                    np.maximum(top, asking @ single[:, t].T, out=top)
                near += top
            bar = np.partition(near, len(first) - k, axis=1)[:, len(first) - k] if len(first) > k else np.full(len(own), -np.inf)
            q, d = np.nonzero(near >= (bar - slack)[:, None])
            score = _scores(own, docs, q, d)
            many = copies[d]
            row, found = np.repeat(q, many), np.repeat(score, many)
            doc = members[np.repeat(begins[d], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((place[doc], -found, row))
            row, found, doc = row[order], found[order], doc[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            out.append((row[rank < k] + at, doc[rank < k], found[rank < k]))
        row, doc, found = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([left["query_id"].take(pa.array(row)), right["doc_id"].take(pa.array(doc)), pa.array(found)], names)

    return go


def cosine_top(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """topk.against_all() of queries(query_id, q_unit) and docs(doc_id, unit) by cosine_maxsim(), both normalized.

    Queries are dealt to blocks and documents to tiles, and each pair of these is a task's matter; it gives k rows a query.
    Rows with missing or odd numbers go by the expression.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = docs.sparkSession
    files.ship(spark)
    left = queries.where("q_unit is not null").select("query_id", "q_unit", _odd("q_unit").alias("odd"))
    right = docs.where("unit is not null").select("doc_id", "unit", F.col("doc_id").cast("string").alias("text"), _odd("unit").alias("odd"))
    n, odd_queries = left.agg(F.count("*"), F.count_if("odd")).first()
    m, odd_docs = right.agg(F.count("*"), F.count_if("odd")).first()
    blocks = max(1, -(-n // block))
    tiles = max(1, -(-m // tile), min(spark.sparkContext.defaultParallelism, -(-m // LEAST)))
    dealt = lambda c, parts: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = left.where("not odd").withColumn("_block", dealt("query_id", blocks)).withColumn("_tile", every(tiles))
    stand = right.where("not odd").withColumn("_tile", dealt("doc_id", tiles)).withColumn("_block", every(blocks))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    found = asked.groupBy("_block", "_tile").cogroup(stand.groupBy("_block", "_tile")).applyInArrow(_best(k), schema)
    score = lambda: cosine_maxsim("q_unit", "unit", unit=True)
    if odd_queries:
        found = found.unionByName(topk.against_all(left.where("odd").select("query_id", "q_unit"), right.select("doc_id", "unit"), score, k).drop("rank"))
    if odd_docs:
        found = found.unionByName(topk.against_all(left.where("not odd").select("query_id", "q_unit"), right.where("odd").select("doc_id", "unit"), score, k).drop("rank"))
    return topk.ranked(found, k)
