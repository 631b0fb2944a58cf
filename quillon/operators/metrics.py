"""Quality metrics as aggregates: ranking, classification and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import quantiles


def per_query(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, ndcg, reciprocal_rank) for each query of qrels(query_id, doc_id).

    hits has (query_id, doc_id, rank). recall is over the rows of qrels, repeated ones included, and the gains over
    distinct documents; the reciprocal rank looks at all hits. Queries without hits have zeros.
    """
    wanted = qrels.groupBy("query_id").agg(F.count("doc_id").alias("expected"), F.countDistinct("doc_id").alias("distinct"))
    return _measured(wanted, hits.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi"), k)


def _measured(wanted: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The measures of wanted(query_id, expected, distinct) and the hits that are relevant."""
    found = relevant.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("double").alias("inside"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
        F.min("rank").alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("distinct"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    both = wanted.join(found, "query_id", "left")
    return both.select(
        "query_id",
        F.coalesce(F.when(F.col("expected") > 0, F.col("inside") / F.col("expected")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.when(F.col("distinct") > 0, F.col("gain") / ideal), F.lit(0.0)).alias("ndcg"),
        F.coalesce(1 / F.col("first").cast("double"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def per_query_by_label(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """per_query() where a document is relevant if it has the query's label, of queries(query_id, label) and
    docs(doc_id, label) with unique ids. Relevant documents are counted by label, not listed."""
    sizes = docs.groupBy("label").agg(F.count("*").alias("expected"))
    wanted = queries.select("query_id", "label").join(sizes, "label", "left").select("query_id", F.coalesce("expected", F.lit(0)).alias("expected"))
    relevant = hits.join(docs.select("doc_id", "label"), "doc_id").join(queries.select("query_id", "label"), ["query_id", "label"])
    return _measured(wanted.withColumn("distinct", F.col("expected")), relevant, k)


def ranking(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over queries: recall, ndcg, mrr and query_count; zeros without queries."""
    return means(per_query(hits, qrels, k))


def means(own: DataFrame) -> DataFrame:
    """ranking() of per_query()'s rows."""
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return own.agg(mean("recall", "recall"), mean("ndcg", "ndcg"), mean("reciprocal_rank", "mrr"), F.count("*").alias("query_count"))


def boundary_ties(scored: DataFrame, k: int) -> DataFrame:
    """An extension: per query, whether the k-th and the next score are equal. scored has (query_id, score, rank) to k + 1."""
    edge = scored.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("last"), F.max(F.when(F.col("rank") == k + 1, F.col("score"))).alias("next"))
    return edge.select("query_id", F.coalesce(F.col("last") == F.col("next"), F.lit(False)).alias("tied"))


def percentiles(frame: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """One row of exact percentiles by linear interpolation, named p50, p95, ...; 0 without rows."""
    found = quantiles.exact(frame.select(F.lit(0).alias("one"), F.col(column).alias("value")), "one", "value", shares)
    return frame.sparkSession.createDataFrame([tuple(found.get((0, s), 0.0) for s in shares)], ", ".join(f"p{round(s * 100)} double" for s in shares))


def aligned(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(query_id, gold, pred) of expected(query_id, label) and predicted(query_id, label); ids of one side only raise."""
    sides = expected.select("query_id", F.col("label").alias("gold"), F.lit(1).alias("in_gold")).join(predicted.select("query_id", F.col("label").alias("pred"), F.lit(1).alias("in_pred")), "query_id", "full")
    lone = sides.where("in_gold is null or in_pred is null").orderBy("query_id").limit(20).collect()
    if lone:
        missing, extra = [r["query_id"] for r in lone if r["in_pred"] is None], [r["query_id"] for r in lone if r["in_gold"] is None]
        raise ValueError(f"query-id mismatch: missing={missing} extra={extra}")
    return sides.drop("in_gold", "in_pred")


def per_label(pairs: DataFrame) -> DataFrame:
    """(label, support, f1) over the labels of either side of pairs(gold, pred)."""
    each = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("e"), (F.col("gold") == F.col("pred")).alias("hit"))
    sums = each.groupBy("e.label").agg(F.sum("e.g").alias("support"), F.sum("e.p").alias("said"), F.sum(F.when(F.col("hit"), F.col("e.g")).otherwise(0)).alias("right"))
    f1 = F.when(F.col("right") > 0, 2.0 * F.col("right") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return sums.select("label", "support", f1.alias("f1"))


def weighted_f1(pairs: DataFrame) -> DataFrame:
    """One row: the labels' F1 weighted by support; 0 without pairs."""
    return per_label(pairs).agg(F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), F.lit(0.0)).alias("weighted_f1"))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """One row: agreement beyond chance; 0 without pairs, 1 where chance alone agrees fully."""
    cells = pairs.groupBy("gold", "pred").agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0.0)).alias("same"))
    gold, pred = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("g")), cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    chance = gold.join(pred, "label").agg(F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0.0)).alias("both"))
    one = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("total"), F.col("both") / (F.col("total") * F.col("total"))
    return one.select(F.when(F.col("total").isNull(), 0.0).when(pe == 1.0, 1.0).otherwise((po - pe) / (1.0 - pe)).alias("cohens_kappa"))


def confusion(pairs: DataFrame, most: int = 2_000) -> DataFrame:
    """(gold, pred, n) for all pairs of labels of either side, zeros included. More than ``most`` labels raise."""
    labels = pairs.select(F.explode(F.array("gold", "pred")).alias("label")).distinct()
    if (n := labels.count()) > most:
        raise ValueError(f"a confusion matrix of {n} labels has {n * n} cells; at most {most} labels are allowed")
    grid = labels.select(F.col("label").alias("gold")).crossJoin(labels.select(F.col("label").alias("pred")))
    cells = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return grid.join(cells, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))
