"""A stored BM25 index: postings by term in blocks with score bounds, and top-k search that skips blocks.

Documents are dealt to buckets by ranges of their number (an integral id itself, else the position by id). A term's documents
of a bucket are cut into blocks of at most BLOCK, in order; a block has the distances of its documents from the bucket's
first number, term frequencies and lengths, and the pairs of frequency and length that no other of its documents exceeds
in both: the greatest score in a block is that of one of these, whatever the parameters and the mean length are.

Beside the postings lie the terms (df, tf) and the corpus (documents, mean length). All tables are Parquet. A term's buckets
are dealt to all files of the postings, each in order of term, so a search for few terms reads their row groups of each
file, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.kernels import text_tokens
from quillon.operators import bm25, topk
from quillon.sources import files, store

#: Documents in a block at most, and document numbers in a bucket.
BLOCK, BUCKET = 64, 1024
#: Buckets per query that are scored first, those with the greatest bounds; the k-th score there is the bar for all others.
PROBED = 4
#: Scores have ten decimals, and bounds are sums in another order.
SLACK = 1e-9

#: Documents whose postings are made at once, beside those of the bucket that they share.
AT_ONCE = 2048
_NO_ID = np.iinfo(np.int64).min
_ROW = "term string, bucket bigint, block int, n int, at array<int>, tf array<int>, length array<int>, impacts array<struct<tf: int, length: int>>"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _part(tf: Column, length: Column, avg_length: Column, k1: float, b: float) -> Column:
    """A term's part of the score, but for its weight."""
    norm = F.lit(1.0 - b) + F.lit(b) * length / F.greatest(avg_length, F.lit(1.0))
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * norm)


def _posted(block: int):
    """From (bucket, at, toks) in order of both to the rows of the postings. Buckets are never cut; of one that the next batch
    may go on with, the documents wait for it."""
    pairs = pa.struct([("tf", pa.int32()), ("length", pa.int32())])

    def lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))

    def blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, place, toks = rows.columns
        length = np.diff(toks.offsets.to_numpy())
        words = toks.flatten().dictionary_encode()
        buckets = bucket.fill_null(_NO_ID).to_numpy()
        run = np.cumsum(np.diff(buckets, prepend=buckets[:1]) != 0)  # the bucket's number among these rows
        size, own = len(words.dictionary), np.repeat(np.arange(len(length)), length)
        # sorted by bucket, term and document; how often a document has the term is its tf
        key, tf = np.unique((run[own] * size + words.indices.to_numpy()) * len(length) + own, return_counts=True)
        term, doc = key // max(len(length), 1), key % max(len(length), 1)
        first = np.flatnonzero(np.diff(term, prepend=-1))  # where each term of a bucket begins
        inside = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        begins = np.flatnonzero(inside % block == 0)
        ends = np.append(begins, len(key))
        n, at = np.diff(ends), place.fill_null(0).to_numpy()
        # of a block's pairs by falling tf and rising length, those shorter than all before them
        number = np.repeat(np.arange(len(begins)), n)
        best = np.lexsort((length[doc], -tf, number))
        low = length[doc][best] - (number << 32)  # all of a block are below all of the blocks before it
        kept = np.flatnonzero(low < np.append(np.iinfo(np.int64).max, np.minimum.accumulate(low)[:-1])[: len(low)])
        best, impacts = best[kept], np.append(0, np.cumsum(np.bincount(number[kept], minlength=len(begins))))
        pair = pa.StructArray.from_arrays([pa.array(tf[best].astype(np.int32)), pa.array(length[doc][best].astype(np.int32))], fields=list(pairs))
        columns = [
            words.dictionary.take(pa.array(term[begins] % max(size, 1))), bucket.take(pa.array(doc[begins])), pa.array((inside[begins] // block).astype(np.int32)), pa.array(n.astype(np.int32)),
            lists(ends, at[doc]), lists(ends, tf), lists(ends, length[doc]), lists(impacts, pair),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "bucket", "block", "n", "at", "tf", "length", "impacts"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                buckets = part.column(0).fill_null(_NO_ID).to_numpy()
                last = int(np.searchsorted(buckets, buckets[-1]))
                if waiting and waiting[-1].column(0).fill_null(_NO_ID)[0].as_py() != buckets[-1]:
                    yield blocks(pa.concat_batches([*waiting, part.slice(0, last)]))
                    waiting = []
                elif not waiting and last:
                    yield blocks(pa.concat_batches([part.slice(0, last)]))
                waiting.append(part.slice(last))
        if waiting:
            yield blocks(pa.concat_batches(waiting))

    return go


@dataclass
class Index:
    """Where an index lies, and how it was made."""

    spark: SparkSession
    path: str
    bucket: int
    id_kind: T.DataType

    @property
    def numbered(self) -> bool:
        """Whether documents go by a number that is not their id."""
        return not isinstance(self.id_kind, _INTEGRAL)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(files.join(self.path, name))

    def postings(self) -> DataFrame:
        """(term, bucket, block, n, at, tf, length, impacts)."""
        return self._table("postings")

    def terms(self) -> DataFrame:
        """(term, df, tf)."""
        return self._table("terms")

    def corpus(self) -> DataFrame:
        """One row: n_docs and avg_length."""
        return self._table("corpus")

    def ids(self, hits: DataFrame) -> DataFrame:
        """hits with doc_id in place of doc."""
        if not self.numbered:
            return hits.withColumn("doc_id", F.col("doc").cast(self.id_kind)).drop("doc")
        return hits.join(self._table("ids"), "doc").drop("doc")


def build(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> Index:
    """Write an index of docs(doc_id, text) with unique ids, in a new folder of the shared one by default, which goes with the
    application. Null texts count as documents without terms. Texts are dealt to tasks by bucket, in the one shuffle there
    is; a task has all documents of its buckets, so their postings are made and ordered where they are."""
    spark = docs.sparkSession
    files.ship(spark)
    path = folder or files.new_folder(spark, "postings")
    id_kind = docs.schema[id_col].dataType
    index = Index(spark, path, bucket, id_kind)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if index.numbered:
        own = store.row_ids(own, "doc_id").withColumn("doc", F.col("_rowid").cast("bigint"))
        own.select("doc", "doc_id").write.parquet(files.join(path, "ids"))
    else:
        own = own.withColumn("doc", F.col("doc_id").cast("bigint"))
    place = [F.expr(f"(doc - pmod(doc, {bucket}L)) div {bucket}").alias("bucket"), F.pmod("doc", F.lit(bucket)).cast("int").alias("at")]
    dealt = own.select(*place, "text").repartition("bucket").sortWithinPartitions("bucket", "at")
    toks = dealt.select("bucket", "at", F.coalesce(text_tokens("text"), F.array().cast("array<string>")).alias("toks"))
    ordered = files.join(path, "postings")
    toks.mapInArrow(_posted(block), _ROW).sortWithinPartitions("term", "bucket", "block").write.option("compression", "zstd").parquet(ordered)
    counted = spark.read.parquet(ordered).select("term", "n", F.aggregate("tf", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("tf"))
    counted.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tf").alias("tf")).sortWithinPartitions("term").write.option("compression", "zstd").parquet(files.join(path, "terms"))
    n = docs.count()
    tokens = F.coalesce(F.sum("tf"), F.lit(0)).cast("double")
    index.terms().agg(F.lit(n).cast("bigint").alias("n_docs"), (tokens / max(n, 1)).alias("avg_length")).write.parquet(files.join(path, "corpus"))
    return index


def weights(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, avg_length) of queries(query_id, text): terms that the index has, weighed by idf and by how
    often the query has them."""
    n, d = F.col("n_docs").cast("double"), F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5))
    asked = bm25.query_terms(queries).join(index.terms(), "term").crossJoin(index.corpus())  # one row
    return asked.select("query_id", "term", (F.col("times") * idf).alias("weight"), "avg_length")


def _wanted(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the terms asked for. A few terms are pushed down to the scan."""
    few = asked.select("term").distinct().limit(bm25.LITERAL_TERMS + 1).collect()
    found = index.postings()
    if len(few) <= bm25.LITERAL_TERMS:
        return found.where(F.col("term").isin([r["term"] for r in few]))
    return found


def _scored(index: Index, blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, doc, score, matched_terms) from blocks(query_id, weight, avg_length, bucket, at, tf, length)."""
    each = blocks.select("query_id", "weight", "avg_length", "bucket", F.explode(F.arrays_zip("at", "tf", "length")).alias("p"))
    part = F.col("weight") * _part(F.col("p.tf"), F.col("p.length"), F.col("avg_length"), k1, b)
    own = each.select("query_id", (F.col("bucket") * index.bucket + F.col("p.at")).alias("doc"), part.alias("part"))
    return own.groupBy("query_id", "doc").agg(F.round(F.sum("part"), 10).alias("score"), F.count("*").alias("matched_terms")).where("score > 0")


def scores(index: Index, queries: DataFrame, *, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """bm25.scores() of all documents, from the index."""
    asked = weights(index, queries)
    return index.ids(_scored(index, _wanted(index, asked).join(asked, "term"), k1, b)).select("query_id", "doc_id", "score", "matched_terms")


def bounds(index: Index, queries: DataFrame, *, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """(query_id, term, weight, avg_length, bucket, block, upper, rest) of each block of the queries' terms: the greatest part
    of a score in the block, and the greatest that the query's other terms can add in its bucket."""
    asked = weights(index, queries)
    meta = _wanted(index, asked).select("term", "bucket", "block", "impacts").join(asked, "term")
    upper = F.col("weight") * F.array_max(F.transform("impacts", lambda i: _part(i["tf"], i["length"], F.col("avg_length"), k1, b)))
    each = files.stored(meta.select("query_id", "term", "weight", "avg_length", "bucket", "block", upper.alias("upper")), "bounds")
    tops = each.groupBy("query_id", "bucket", "term").agg(F.max("upper").alias("top"))
    whole = tops.groupBy("query_id", "bucket").agg(F.sum("top").alias("whole"))
    both = each.join(tops, ["query_id", "bucket", "term"]).join(whole, ["query_id", "bucket"])
    return both.select("query_id", "term", "weight", "avg_length", "bucket", "block", "upper", (F.col("whole") - F.col("top")).alias("rest"))


def _plan(index: Index, queries: DataFrame, k: int, k1: float, b: float, probed: int) -> tuple[DataFrame, DataFrame]:
    """(all blocks of the queries' terms with whether they are read, bars by query)."""
    found = files.stored(bounds(index, queries, k1=k1, b=b), "blocks")
    whole = found.groupBy("query_id", "bucket").agg(F.max(F.col("upper") + F.col("rest")).alias("score"))
    first = topk.ranked(whole, probed, id_col="bucket").select("query_id", "bucket")
    probe = found.join(first, ["query_id", "bucket"], "left_semi")
    near = topk.ranked(_scored(index, _filled(index, probe), k1, b), k, id_col="doc")
    bars = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    read = F.coalesce(F.col("upper") + F.col("rest") >= F.col("bar") - SLACK, F.lit(True))
    return found.join(bars, "query_id", "left").withColumn("read", read), bars


def _filled(index: Index, blocks: DataFrame) -> DataFrame:
    """blocks with their postings."""
    own = _wanted(index, blocks).select("term", "bucket", "block", "at", "tf", "length")
    return own.join(blocks.select("query_id", "weight", "avg_length", "term", "bucket", "block"), ["term", "bucket", "block"])


def top(index: Index, queries: DataFrame, k: int, *, k1: float = bm25.K1, b: float = bm25.B, probed: int = PROBED) -> DataFrame:
    """The k best documents of each query, as bm25.scores() ranks them: (query_id, doc_id, score, rank, matched_terms).

    The buckets with the greatest bounds are scored first. A block is left out where the greatest score in it and what the
    query's other terms can add in its bucket stay below the k-th score found there: none of its documents can be among
    the k best, and all blocks of those that can are read.
    """
    plan, _ = _plan(index, queries, k, k1, b, probed)
    hits = index.ids(_scored(index, _filled(index, plan.where("read")), k1, b))
    return topk.ranked(hits, k).select("query_id", "doc_id", "score", "rank", "matched_terms")


def blocks_read(index: Index, queries: DataFrame, k: int, *, k1: float = bm25.K1, b: float = bm25.B, probed: int = PROBED) -> DataFrame:
    """(query_id, blocks, read): how many blocks the queries' terms have, and how many top() scores in the end."""
    plan, _ = _plan(index, queries, k, k1, b, probed)
    return plan.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(F.col("read").cast("bigint")).alias("read"))
