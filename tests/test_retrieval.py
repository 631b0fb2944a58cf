import math

import pytest

from quillon.functions import filters
from quillon.operators import bm25, retrieval, topk
from quillon.operators.records import Candidate, Clause, Filter, Query
from quillon.sources import store

ROWS = [("a", [3], [[0.7, 0.7]], "alpha", 1, "phishing mail phishing"), ("b", [3], [[1.0, 0.0]], "beta", 2, "beacon host"), ("c", [0], [[0.0, 1.0]], "alpha", 3, "mail"), ("10", [3], [[1.0, 0.0]], None, None, ""), ("9", None, None, "beta", 4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id string, bin array<bigint>, fp16 array<array<float>>, tenant string, severity bigint, text string").cache()


def ids(found):
    return [c.alert_id for c in found]


def test_binary_order_ties_and_nulls(docs):
    lane = retrieval.BinaryRetriever(docs)
    found = lane.search(Query(binary=[3]), 10)
    assert ids(found) == ["10", "a", "b", "c"] and [c.score for c in found] == [48.0, 48.0, 48.0, 46.0]
    assert found[0].stage == "binary_hamming" and lane.size() == 5
    assert ids(lane.search(Query(binary=[3]), 2)) == ["10", "a"]


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        (("tenant", "eq", "alpha"), {"a", "c"}), (("tenant", "ne", "alpha"), {"b"}), (("severity", "lt", 2), {"a"}), (("severity", "lte", 2), {"a", "b"}), (("severity", "gt", 2), {"c"}),
        (("severity", "gte", 2), {"b", "c"}), (("tenant", "in", ("alpha", "gamma")), {"a", "c"}), (("tenant", "not_in", ("alpha",)), {"b"}),
    ],
)
def test_filters(docs, clause, want):
    found = retrieval.BinaryRetriever(docs).search(Query(binary=[3], filter=Filter((Clause(*clause),))))
    assert set(ids(found)) == want


def test_filters_together_and_none(docs):
    both = Filter((Clause("tenant", "eq", "alpha"), Clause("severity", "gt", 1)))
    assert ids(retrieval.BinaryRetriever(docs).search(Query(binary=[3], filter=both))) == ["c"]
    assert len(retrieval.BinaryRetriever(docs).search(Query(binary=[3], filter=Filter()))) == 4


def test_filter_errors(docs):
    for op in ("in", "not_in"):
        for value in ((), "x"):
            with pytest.raises(ValueError, match=f"{op} filters require a non-empty tuple value"):
                filters.apply(docs, Filter((Clause("tenant", op, value),)))
    for op in ("eq", "ne", "lt", "lte", "gt", "gte"):
        with pytest.raises(ValueError, match=f"{op} filters do not accept tuple values"):
            filters.apply(docs, Filter((Clause("tenant", op, ("x",)),)))
    with pytest.raises(ValueError, match="unsupported filter operator"):
        Clause("tenant", "like", "x")
    with pytest.raises(ValueError, match="unknown filter field"):
        filters.apply(docs, Filter((Clause("tenant = 'alpha' OR 1", "eq", 1),)))
    with pytest.raises(ValueError, match="Raw SQL filter strings"):
        Query(filter_expr="1 = 1")
    with pytest.raises(ValueError, match="combinator"):
        Filter((), "or")
    for lane in (retrieval.BM25Retriever(docs), retrieval.CosineRetriever(docs)):
        with pytest.raises(NotImplementedError):
            lane.search(Query(text="x", fp16=[[1.0, 0.0]], filter=Filter((Clause("tenant", "eq", "x"),))))
    allowed = retrieval.CosineRetriever(docs, allow_filters=True)
    assert ids(allowed.search(Query(fp16=[[1.0, 0.0]], filter=Filter((Clause("tenant", "eq", "beta"),))))) == ["b"]


def test_required_fields_and_k(docs):
    binary, lexical = retrieval.BinaryRetriever(docs), retrieval.BM25Retriever(docs)
    staged = retrieval.BinaryThenCosine(binary, docs)
    for lane, query, name in ((binary, Query(), "binary"), (lexical, Query(), "text"), (staged, Query(), "binary"), (staged, Query(binary=[1]), "fp16"), (retrieval.CosineRetriever(docs), Query(), "fp16")):
        with pytest.raises(ValueError, match=f"requires query {name}"):
            lane.search(query, 0)
    with pytest.raises(ValueError, match="k must be >= 1"):
        binary.search(Query(binary=[1]), 0)
    with pytest.raises(ValueError, match="unknown stage"):
        Candidate("a", 1.0, "other")


def test_cosine_and_store(spark, docs, tmp_path):
    want = retrieval.CosineRetriever(docs).search(Query(fp16=[[1.0, 0.0]]))
    assert ids(want) == ["10", "b", "a", "c"] and want[2].score == pytest.approx(2**-0.5, abs=1e-6)
    path = str(tmp_path / "mv")
    store.write_multivectors(store.multivectors(spark, ["a", "b"], [[[0.7, 0.7]], [[1.0, 0.0]]], ["x", "y"]), path)
    assert store.read_manifest(spark, path)["row_count"] == 2
    lane = retrieval.StoreRetriever(spark, path)
    assert ids(lane.search(Query(fp16=[[1.0, 0.0]]))) == ["b", "a"] and lane.size() == 2
    for bad in (([], [[[1.0]]], ["x"]), (["a"], [[[1.0]]], None), (["a"], [[[1.0], [1.0, 2.0]]], ["x"]), (["a"], [[1.0]], ["x"])):
        with pytest.raises(ValueError):
            store.multivectors(spark, *bad)


def test_bm25_by_hand(spark, docs):
    found = retrieval.BM25Retriever(docs).search(Query(text="Phishing, phishing mail"))
    n, avg = 5, (3 + 2 + 1) / 5
    a = 2 * bm25.score_of(2, 1, n, 3, avg) + bm25.score_of(1, 2, n, 3, avg)
    assert ids(found) == ["a", "c"] and found[0].score == pytest.approx(a) and found[1].score == pytest.approx(bm25.score_of(1, 2, n, 1, avg))
    assert found[0].debug == {"matched_terms": 2.0} and found[0].stage == "bm25"
    assert retrieval.BM25Retriever(docs).search(Query(text="!!")) == []
    assert retrieval.BM25Retriever(docs.limit(0)).search(Query(text="mail")) == []


def test_bm25_many_terms_take_the_join(spark, docs, monkeypatch):
    queries = spark.createDataFrame([("q", "phishing mail beacon")], "query_id string, text string")
    want = {r.doc_id: r.score for r in bm25.scores(docs, queries).collect()}
    monkeypatch.setattr(bm25, "LITERAL_TERMS", 1)
    assert {r.doc_id: r.score for r in bm25.scores(docs, queries).collect()} == pytest.approx(want)


def test_staged(docs):
    binary = retrieval.BinaryRetriever(docs)
    staged = retrieval.BinaryThenCosine(binary, docs.where("doc_id <> 'a'"), prefilter=3)
    found, took = staged.search_with_timings(Query(binary=[3], fp16=[[1.0, 0.0]]))
    assert ids(found) == ["10", "b"] == ids(staged.search(Query(binary=[3], fp16=[[1.0, 0.0]])))  # a has no vectors, c no place
    assert found[0].debug == {"binary_score": 48.0} and found[0].stage == "fp16_maxsim" and set(took) == {"candidate_ms", "rerank_ms"}
    only = staged.search(Query(binary=[3], fp16=[[1.0, 0.0]], filter=Filter((Clause("severity", "gte", 2),))))
    assert ids(only) == ["b", "c"]
    hybrid = retrieval.HybridThenCosine(retrieval.BM25Retriever(docs), docs)
    got = hybrid.search(Query(text="mail", fp16=[[0.0, 1.0]]))
    assert ids(got) == ["c", "a"] and got[0].stage == "hybrid" and set(got[0].debug) == {"bm25_score", "matched_terms"}
    none, took = hybrid.search_with_timings(Query(text="nothing", fp16=[[0.0, 1.0]]))
    assert none == [] and took["rerank_ms"] == 0.0
    with pytest.raises(NotImplementedError):
        hybrid.search(Query(text="mail", fp16=[[0.0, 1.0]], filter=Filter((Clause("tenant", "eq", "x"),))))


def test_batches_equal_single_queries_in_any_block(spark, docs):
    queries = spark.createDataFrame([("q1", [3]), ("q2", [0]), ("q3", [])], "query_id string, q_bin array<bigint>")
    want = {(q, c.alert_id, c.score) for q, code in (("q1", [3]), ("q2", [0]), ("q3", [])) for c in retrieval.BinaryRetriever(docs).search(Query(binary=code), 2)}
    for block, tile in ((1, 2), (2, 1), (2, 100), (10, 2)):
        top = topk.against_all(queries.select("query_id", "q_bin"), docs.select("doc_id", "bin"), lambda: retrieval.hamming_maxsim("q_bin", "bin").cast("double"), 2, block, tile)
        assert {(r.query_id, r.doc_id, r.score) for r in top.collect()} == want


def test_upsert_and_fetch(spark):
    table = spark.createDataFrame([("a", 0, "x", 1.0), ("b", 0, "y", None)], "id string, seq int, s string, v double")
    changes = spark.createDataFrame([("a", 1, None, 2.0), ("a", 2, "z", None), ("c", 1, None, 3.0), ("b", 0, "w", None)], "id string, seq int, s string, v double")
    assert sorted(map(tuple, store.upsert(table, changes).collect())) == [("a", 2, "z", 2.0), ("b", 0, "w", None), ("c", 1, None, 3.0)]
    assert [r.id for r in store.fetch(table, ["a", "a", "zz"], "id").collect()] == ["a"] and store.fetch(table, [], "id").count() == 0
    assert store.size(table) == 2 and store.size(table, "v") == 1
    assert [r.id for r in store.in_id_order(spark.createDataFrame([("9",), ("10",)], "id string")).collect()] == ["10", "9"]


def test_fetch_keeps_the_order_asked_for(spark):
    table = spark.createDataFrame([(k, float(k)) for k in range(20)], "id long, v double").repartition(4)
    assert [r.id for r in store.fetch(table, [7, 3, 99, 7, 12, 0], "id").collect()] == [7, 3, 12, 0]


def test_row_ids_are_positions_over_all_partitions(spark):
    table = spark.createDataFrame([(f"k{k:03d}",) for k in range(300)], "id string").repartition(7)
    assert sorted((r.id, r._rowid) for r in store.row_ids(table, "id").collect()) == [(f"k{k:03d}", str(k)) for k in range(300)]
    assert store.row_ids(table.limit(0), "id").collect() == []


def test_row_ids_are_mapped_to_alerts(spark, docs):
    mapping = spark.createDataFrame([("a", "alert-a"), ("10", "alert-10")], "_rowid string, alert_id string")
    for names in (lambda row: {"a": "alert-a", "10": "alert-10"}.get(row, row), mapping):
        assert ids(retrieval.BinaryRetriever(docs, alert_ids=names).search(Query(binary=[3]), 3)) == ["alert-10", "alert-a", "b"]


def test_score_of_is_the_formula():
    assert bm25.score_of(1, 1, 3, 4, 4.0) == pytest.approx(math.log(1 + 2.5 / 1.5))
