import random

import numpy as np
import pytest

from quillon.functions.kernels import normalized
from quillon.operators import pruned, retrieval
from quillon.operators.records import Clause, Filter


def rows(frame):
    return sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in frame.collect())


def share(found, queries, docs):
    return sum(r.n for r in found.scored.collect()) / (queries.count() * docs.count())


@pytest.fixture(scope="module")
def codes(spark):
    """Documents near one of forty codes, with some that are near none, empty or null."""
    r = random.Random(1)
    middles = [[r.getrandbits(48) for _ in range(3)] for _ in range(40)]
    near = lambda w, n: w ^ sum(1 << b for b in r.sample(range(48), r.randrange(n)))
    docs = [(i, [near(w, 3) for w in middles[i % 40]], i % 3) for i in range(800)] + [(800 + i, [r.getrandbits(48)], 0) for i in range(20)] + [(900, [], 1), (901, None, 1)]
    queries = [(f"q{i}", [near(w, 2) for w in middles[i]]) for i in range(20)] + [("far", [r.getrandbits(48)]), ("none", []), ("null", None)]
    return spark.createDataFrame(docs, "doc_id long, bin array<bigint>, tenant int"), spark.createDataFrame(queries, "query_id string, q_bin array<bigint>")


@pytest.mark.parametrize("k", [1, 10, 30])
def test_codes_equal_the_plain_lane(codes, k):
    docs, queries = codes
    found = pruned.binary_search(queries, docs, k)
    assert rows(found.hits) == rows(retrieval.binary_lane(queries, docs, k))
    if k == 10:
        near = [r for r in found.scored.collect() if r.query_id.startswith("q")]
        assert all(r.level >= 0 for r in near) and sum(r.n for r in near) < 0.1 * 20 * docs.count()


def test_codes_with_a_filter_and_a_stored_index(codes):
    docs, queries = codes
    where = Filter((Clause("tenant", "eq", 1),))
    found = pruned.binary_search(queries, docs, 4, where, postings=pruned.binary_postings(docs))
    assert rows(found.hits) == rows(retrieval.binary_lane(queries, docs, 4, where))


def vectors(spark, spread):
    r = np.random.default_rng(2)
    middles = r.normal(size=(60, 4, 16))
    own = lambda i: (middles[i % 60] + spread * r.normal(size=(4, 16))).tolist()
    docs = [(i, own(i), i % 3) for i in range(1200)] + [(5000, [[0.0] * 16, r.normal(size=16).tolist()], 0), (5001, [], 0), (5002, None, 0)]
    queries = [(f"q{i}", own(i)) for i in range(15)] + [("zero", [[0.0] * 16] * 2), ("mixed", [[0.0] * 16, r.normal(size=16).tolist()]), ("none", [])]
    return spark.createDataFrame(docs, "doc_id long, fp16 array<array<double>>, tenant int"), spark.createDataFrame(queries, "query_id string, q_fp16 array<array<double>>")


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_vectors_equal_the_plain_lane(spark, spread):
    docs, queries = vectors(spark, spread)
    found = pruned.cosine_search(queries, docs, 10)
    assert rows(found.hits) == rows(retrieval.cosine_lane(queries, docs, 10))
    near = [r for r in found.scored.collect() if r.query_id.startswith("q")]
    if spread < 1:  # clustered: below a fifth of the pairs
        assert all(r.level >= 0 for r in near) and sum(r.n for r in near) < 0.2 * 15 * docs.count()


def test_vectors_with_a_filter_and_a_shared_index(spark):
    docs, queries = vectors(spark, 0.05)
    where = Filter((Clause("tenant", "ne", 2),))
    index = pruned.clusters(docs.select("doc_id", normalized("fp16").alias("unit")))
    assert rows(pruned.cosine_search(queries, docs, 5, where, index=index).hits) == rows(retrieval.cosine_lane(queries, docs, 5, where))


def test_no_documents_and_no_queries(spark, codes):
    docs, queries = codes
    assert pruned.binary_search(queries, docs.limit(0), 3).hits.collect() == []
    assert pruned.binary_search(queries.limit(0), docs, 3).hits.collect() == []
    dense, asked = vectors(spark, 0.05)
    assert pruned.cosine_search(asked, dense.limit(0), 3).hits.collect() == []
    with pytest.raises(ValueError, match="k must be >= 1"):
        pruned.binary_search(queries, docs, 0)


def test_queries_with_long_lists_are_held_against_all_documents_at_once(spark, monkeypatch):
    monkeypatch.setattr(pruned, "FEW", 0)
    monkeypatch.setattr(pruned, "SHARE", 0.0)
    docs, queries = vectors(spark, 2.0)
    found = pruned.cosine_search(queries, docs, 10)
    assert rows(found.hits) == rows(retrieval.cosine_lane(queries, docs, 10))
    assert {(r.level, r.n) for r in found.scored.collect() if r.query_id.startswith("q")} == {(-1, docs.count())}
