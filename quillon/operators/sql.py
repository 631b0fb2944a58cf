"""Search from SQL: a table function that is called with LATERAL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillon.functions import kernels

#: The greatest k that a search function takes; each task keeps so many rows a query before the shuffle.
MOST = 1_000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register_search(docs: DataFrame, *, name: str = "hamming_topk", label: str | None = None, most: int = MOST) -> None:
    """Make a table function of docs(doc_id, bin, ...) for the session:

        SELECT q.id, t.* FROM asked q, LATERAL hamming_topk(q.bin, 10, array(1, 5)) t

    gives (doc_id, score, rank): the k documents with the highest Hamming MaxSim, ties by id as text. The third argument
    are the values of the column ``label`` that are admitted, NULL admits all; without a label the function has two
    arguments. Filter the queries in a view or subquery of their own: the function runs for each distinct code in it. A k
    beyond ``most`` raises.
    """
    spark = docs.sparkSession
    kernels.register(spark)
    view = f"_quillon_{name}"
    docs.createOrReplaceTempView(view)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    third = f", allowed ARRAY<{kinds[label]}>" if label else ""
    where = f"WHERE allowed IS NULL OR array_contains(allowed, {_quoted(label)})" if label else ""
    order = "ORDER BY score DESC, CAST(doc_id AS STRING)"
    scored = f"SELECT doc_id, CAST(hamming_maxsim(q, bin) AS DOUBLE) AS score FROM {view} {where}"
    best = f"SELECT doc_id, score FROM ({scored}) WHERE score IS NOT NULL {order} LIMIT {int(most)}"
    ranked = f"SELECT doc_id, score, row_number() OVER ({order}) AS rank FROM ({best})"
    too_many = f"CAST(raise_error('k must be between 1 and {int(most)}') AS BOOLEAN)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {_quoted(name)}(q ARRAY<BIGINT>, k INT{third}) RETURNS TABLE(doc_id {kinds["doc_id"]}, score DOUBLE, rank INT)
        RETURN SELECT doc_id, score, rank FROM ({ranked}) WHERE CASE WHEN k BETWEEN 1 AND {int(most)} THEN rank <= k ELSE {too_many} END""")
