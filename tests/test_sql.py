import random

import pytest

from quillon.operators import retrieval, sql
from quillon.operators.records import Clause, Filter


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(f"d{i}", [r.getrandbits(48) for _ in range(r.randrange(1, 4))], r.choice(["a", "b", None])) for i in range(120)] + [("none", None, "a"), ("empty", [], "b")], "doc_id string, bin array<bigint>, tenant string")
    queries = spark.createDataFrame([(f"q{i}", [r.getrandbits(48) for _ in range(2)]) for i in range(6)] + [("same", [5]), ("again", [5])], "query_id string, q_bin array<bigint>")
    return docs, queries


def rows(frame):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in frame.collect())


def test_the_table_function_equals_the_lane(spark, tables):
    docs, queries = tables
    queries.createOrReplaceTempView("asked_sql")
    sql.register_search(docs, name="search_all", label="tenant", most=50)
    ask = lambda k, allowed: spark.sql(f"SELECT q.query_id, t.* FROM asked_sql q, LATERAL search_all(q.q_bin, {k}, {allowed}) t")
    for k in (1, 7, 50):
        assert rows(ask(k, "NULL")) == rows(retrieval.binary_lane(queries, docs, k))
    assert rows(ask(4, "array('a')")) == rows(retrieval.binary_lane(queries, docs, 4, Filter((Clause("tenant", "eq", "a"),))))
    assert "WindowGroupLimit" in ask(3, "NULL")._jdf.queryExecution().executedPlan().toString()
    for k in (0, 51):
        with pytest.raises(Exception, match="k must be between 1 and 50"):
            ask(k, "NULL").collect()


def test_without_a_label(spark, tables):
    docs, queries = tables
    queries.createOrReplaceTempView("asked_sql")
    sql.register_search(docs.select("doc_id", "bin"), name="search_plain")
    assert rows(spark.sql("SELECT q.query_id, t.* FROM asked_sql q, LATERAL search_plain(q.q_bin, 5) t")) == rows(retrieval.binary_lane(queries, docs, 5))
