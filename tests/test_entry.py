import duckdb
import pytest

import __spark_entry__
from quillon.functions.kernels import hamming_maxsim
from quillon.operators import topk
from quillon.plans import queries
from quillon.streaming import search

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"query_id", "doc_id", "score", "rank", "binary_score"} <= set(rows[0].asDict())


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["binary_encode", "binary_then_cosine", "bm25_topk", "filter_not_in", "ranking_per_query", "judge_scores", "store_upsert", "cohens_kappa", "lane_comparison", "audit_and_gates", "hybrid_then_cosine", "rotated_codes", "hamming_bytes_sql", "store_row_ids", "replay_scores", "binary_thresholds", "latency_percentiles"])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in "part orders lineitem documents embeddings labels events".split():
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = c.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_streamed_queries(spark, tmp_path):
    queries_in = spark.createDataFrame([("q1", [3]), ("q2", [0])], "query_id string, q_bin array<bigint>")
    queries_in.write.parquet(str(tmp_path / "in"))
    docs = spark.createDataFrame([("a", [3]), ("b", [0])], "doc_id string, bin array<bigint>")
    lane = lambda batch: topk.against_all(batch, docs, lambda: hamming_maxsim("q_bin", "bin").cast("double"), 1)
    stream = spark.readStream.schema(queries_in.schema).parquet(str(tmp_path / "in"))
    run = search.search_stream(stream, lane, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert run.awaitTermination(60)
    assert {(r.query_id, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("q1", "a"), ("q2", "b")}


def test_latency_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, cast(id AS double) AS ms FROM range(11)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, ms double").parquet(str(tmp_path / "in"))
    run = search.latency_windows(stream, "ts", "ms").writeStream.outputMode("complete").format("memory").queryName("quillon_latency").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted((r.n, r.mean, r.most) for r in spark.table("quillon_latency").collect()) == [(1, 10.0, 10.0), (5, 2.0, 4.0), (5, 7.0, 9.0)]
