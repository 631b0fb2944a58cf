"""Exact batch search by MaxSim that scores a part of the pairs.

Documents are posted under lists that their tokens belong to. A query looks into the lists nearest to its tokens first,
and scores what it meets there. What it has not met has a greatest possible score; where the k-th score found is above that
bound, the query is done, else it looks into more lists. Queries that no list bounds well enough are held against all
documents in the end, so results never differ from those of the plain lanes, ties included.

Binary codes go by multi-index hashing: a token is posted under each of its four 12-bit parts, and two tokens that differ
in less than 4 (s + 1) bits differ in at most s bits in one part. Vectors go by clusters: a token is posted under its
nearest centre and its angle to it, in rings; by the triangle inequality for angles, two tokens are no closer than their
angles to one centre differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import filters
from quillon.functions.kernels import BITS, cosine_maxsim, hamming_maxsim, normalized
from quillon.operators import dense, topk
from quillon.operators.records import Filter
from quillon.sources import files

PARTS = 4
WIDTH = BITS // PARTS
#: Bits in which a part may differ, level by level.
FLIPS = (0, 1, 2)
#: Centres, taken from the documents' tokens by a hash, and the width of a ring in radians.
CENTRES, RING = 256, math.pi / 48
#: Lists that each query token looks into, level by level.
LISTS = (4, 16, 64)
#: Postings that a query looks through at a level, at least and as a share of the documents; with more of them it is held
#: against all documents, where a pair costs far less than one that lists bring together.
FEW, SHARE = 1_000, 0.005
#: Bounds of angles lose some digits near zero.
SLACK = 1e-6


@dataclass
class Found:
    """hits(query_id, doc_id, score, rank); scored(query_id, level, n): pairs scored at each level of lists, and at level -1
    those of queries that were held against all documents."""

    hits: DataFrame
    scored: DataFrame


def search(queries: DataFrame, docs: DataFrame, postings: DataFrame, probes: DataFrame, rests: DataFrame, score: Callable[[], Column], k: int, every: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Found:
    """The k best of docs(doc_id, ...) for each of queries(query_id, ...) by score(), a column over both sides' columns.

    postings(list, doc_id) are the lists; probes(query_id, level, list) those that a query looks into at a level, from 0;
    rests(query_id, level, rest) the greatest score of a document that it has not met up to a level. Each level's scores
    are written in the shared folder. Queries whose lists are long (FEW, SHARE), or bound them badly, are held against all
    documents by every(queries, docs), which is topk.against_all() by default.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    levels = sorted(r["level"] for r in rests.select("level").distinct().collect())  # a few
    found = counts = None
    size = docs.count()
    lengths = postings.groupBy("list").agg(F.count("*").alias("n"))
    costs = probes.join(lengths, "list").groupBy("query_id", "level").agg(F.sum("n").alias("n"))
    dear = files.stored(costs.where(F.col("n") > max(FEW, SHARE * size)).groupBy("query_id").agg(F.min("level").alias("level")), "dear")
    open_, late = queries.select("query_id"), []
    for level in levels:
        long = dear.where(F.col("level") == level).select("query_id")
        late.append(open_.join(long, "query_id", "left_semi"))
        open_ = files.stored(open_.join(long, "query_id", "left_anti"), "worth")
        if open_.isEmpty():
            break
        met = probes.where(F.col("level") == level).join(open_, "query_id").join(postings, "list").select("query_id", "doc_id").distinct()
        if found is not None:
            met = met.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        own = met.join(docs, "doc_id").join(queries, "query_id").select("query_id", "doc_id", score().alias("score"))
        own = files.stored(own.where("score is not null"), f"level-{level}")
        n = own.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(level).alias("level"), "n")
        found, counts = (own, n) if found is None else (found.unionByName(own), counts.unionByName(n))
        bars = topk.ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        rest = rests.where(F.col("level") == level).select("query_id", "rest")
        open_ = open_.join(rest, "query_id", "left").join(bars, "query_id", "left").where("bar is null or rest is null or bar <= rest").select("query_id")
        open_ = files.stored(open_, "open")
        if open_.isEmpty():
            break
    for other in late:
        open_ = open_.unionByName(other)
    open_ = files.stored(open_, "all")
    if found is None or not open_.isEmpty():
        left = queries.join(open_, "query_id", "left_semi")
        every = every(left, docs) if every else topk.against_all(left, docs, score, k)
        last = open_.select("query_id", F.lit(-1).alias("level"), F.lit(size).cast("bigint").alias("n"))
        hits = topk.ranked(found.join(open_, "query_id", "left_anti"), k).unionByName(every) if found is not None else every
        return Found(hits, last if counts is None else counts.unionByName(last))
    return Found(topk.ranked(found, k), counts)


# Binary codes ----------------------------------------------------------------------------------------------------------


def _parts(word: Column) -> list[Column]:
    """The lists of a word: one for each part and its value."""
    return [F.lit(p << WIDTH) + F.shiftright(word, p * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)) for p in range(PARTS)]


def binary_postings(docs: DataFrame) -> DataFrame:
    """(list, doc_id) of docs(doc_id, bin)."""
    return docs.select("doc_id", F.explode("bin").alias("w")).select("doc_id", F.explode(F.array(*_parts(F.col("w")))).alias("list")).select("list", "doc_id").distinct()


def binary_search(queries: DataFrame, docs: DataFrame, k: int, where: Filter | None = None, *, postings: DataFrame | None = None, flips: Sequence[int] = FLIPS) -> Found:
    """retrieval.binary_lane() by multi-index hashing. postings, as binary_postings() gives them, can be a stored table."""
    kept = filters.apply(docs, where).select("doc_id", "bin")
    postings = binary_postings(kept) if postings is None else postings
    left = queries.select("query_id", "q_bin")
    masks = {s: [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), s)] for s in range(max(flips) + 1)}
    words = left.select("query_id", F.explode("q_bin").alias("w"))
    probes = rests = None
    for level, s in enumerate(flips):
        own = [m for t in range(s + 1) for m in masks[t]]
        near = F.transform(F.array(*(F.lit(m) for m in own)), lambda m: F.array(*(x.bitwiseXOR(m.cast("bigint")) for x in _parts(F.col("w")))))
        more = words.select("query_id", F.lit(level).alias("level"), F.explode(F.flatten(near)).alias("list")).distinct()
        rest = left.select("query_id", F.lit(level).alias("level"), (F.size("q_bin") * (BITS - 4 * (s + 1))).cast("double").alias("rest"))
        probes, rests = (more, rest) if probes is None else (probes.unionByName(more), rests.unionByName(rest))
    return search(left, kept, postings, probes, rests, lambda: hamming_maxsim("q_bin", "bin").cast("double"), k)


# Vectors ---------------------------------------------------------------------------------------------------------------


@dataclass
class Clusters:
    """Centres as rows of unit length, the number of rings of each, rings(list, low, high) with the range of their angles, and
    postings(list, doc_id) of the tokens in them. A list is a centre's number times that of its rings, plus the ring's."""

    centres: np.ndarray
    rings_each: int
    rings: DataFrame
    postings: DataFrame


#: The list of tokens of length zero, whose cosine to all others is 0.
ZERO = -1


def _angles(tokens: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(tokens @ centres.T, -1, 1))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens as rows, number of tokens of each row) of a column of arrays of arrays of one width."""
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    each = column.flatten()
    n = len(each)
    return (each.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))), sizes


def clusters(docs: DataFrame, *, centres: int = CENTRES, ring: float = RING) -> Clusters:
    """Centres and rings of docs(doc_id, unit), whose tokens have length 1 or 0. The centres are a bounded number of tokens of
    the least hashes; all tokens are posted, and the rings' bounds are over all of them. Both tables are written in the
    shared folder."""
    files.ship(docs.sparkSession)
    each = docs.select("doc_id", F.posexplode("unit").alias("pos", "v"))
    picked = each.where(F.exists("v", lambda x: x != 0)).select(F.xxhash64(F.col("doc_id").cast("string"), "pos").alias("h"), "v").orderBy("h", "v").limit(centres).collect()
    middle = np.array([r["v"] for r in picked], np.float64) if picked else np.zeros((0, 1))
    rings = 1 + int(math.pi / ring)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = _tokens(batch.column(1))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            angle, place = np.zeros(len(tokens)), np.full(len(tokens), ZERO)
            some = np.flatnonzero((tokens != 0).any(axis=1))
            for i in range(0, len(some), 4096):
                own = some[i : i + 4096]
                all_ = _angles(tokens[own], middle)
                nearest = all_.argmin(axis=1)
                angle[own] = all_[np.arange(len(own)), nearest]
                place[own] = nearest * rings + (angle[own] / ring).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(place), pa.array(angle)], names=["doc_id", "list", "angle"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    posted = files.stored(docs.where("unit is not null").select("doc_id", "unit").mapInArrow(post, f"doc_id {kind}, list bigint, angle double"), "clusters")
    own = posted.groupBy("list").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    return Clusters(middle, rings, files.stored(own, "rings"), posted.select("list", "doc_id").distinct())


def cosine_search(queries: DataFrame, docs: DataFrame, k: int, where: Filter | None = None, *, index: Clusters | None = None, lists: Sequence[int] = LISTS) -> Found:
    """retrieval.cosine_lane() by cluster bounds. index is what clusters() gives for documents with unit tokens, all of them
    where a filter narrows docs(doc_id, fp16)."""
    files.ship(docs.sparkSession)
    kept = filters.apply(docs, where).select("doc_id", normalized("fp16").alias("unit"))
    index = clusters(kept) if index is None else index
    left = queries.select("query_id", normalized("q_fp16").alias("q_unit"))
    known = index.rings.orderBy("list").toArrow()  # at most a row for each centre and ring
    name, low, high = (known.column(c).to_numpy() for c in ("list", "low", "high"))
    centre, centres = np.where(name == ZERO, 0, name // index.rings_each), index.centres

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = _tokens(batch.column(1))
            ends = np.cumsum(sizes)
            rows: list[tuple] = []
            for r, query in enumerate(batch.column(0).to_pylist()):
                own = tokens[ends[r] - sizes[r] : ends[r]]
                bound = np.zeros((len(own), len(name)))
                some = np.flatnonzero((own != 0).any(axis=1))
                if len(some) and len(centres):
                    angle = _angles(own[some], centres)[:, centre]
                    bound[some] = np.where(name == ZERO, 0.0, np.cos(np.maximum(np.maximum(angle - high, low - angle), 0)))
                order = np.argsort(-bound, axis=1, kind="stable")
                for level, m in enumerate(lists):
                    near = np.unique(name[order[:, :m]]).tolist()
                    rest = float(sum(bound[t, order[t, m]] for t in range(len(own)))) + SLACK * len(own) if m < len(name) else None
                    rows += [(query, level, x, None) for x in near] + [(query, level, None, -np.inf if rest is None else rest)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (batch.column(0).type, pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "level", "list", "rest"])

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, level int, list bigint, rest double"
    found = files.stored(left.where("q_unit is not null").mapInArrow(look, schema), "probes")
    probes, rests = found.where("list is not null").select("query_id", "level", "list"), found.where("list is null").select("query_id", "level", "rest")
    return search(left, kept, index.postings, probes, rests, lambda: cosine_maxsim("q_unit", "unit", unit=True), k, lambda some, all_: dense.cosine_top(some, all_, k))
