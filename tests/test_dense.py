import random

import pytest

from quillon.functions.kernels import cosine_maxsim
from quillon.operators import dense, topk


def rows(frame):
    return sorted((str(r.query_id), str(r.doc_id), repr(r.score), r["rank"]) for r in frame.collect())


@pytest.fixture(scope="module")
def tables(spark):
    """Documents with many copies, copies of a part, empty and null ones, zeros, and numbers that are none."""
    from quillon.functions.kernels import normalized

    r = random.Random(4)
    some = lambda n: [[r.gauss(0, 1) for _ in range(7)] for _ in range(n)]
    kinds = [some(1 + i % 4) for i in range(40)]
    docs = [(i, kinds[i % 40] if i < 300 else some(3)) for i in range(700)] + [(701, []), (702, None), (703, [[0.0] * 7, *some(1)]), (704, [[float("nan")] * 7]), (705, [some(1)[0], None])]
    queries = [(f"q{i}", kinds[i]) for i in range(0, 40, 3)] + [("far", some(5)), ("none", []), ("null", None), ("zero", [[0.0] * 7]), ("odd", [[None] * 7])]
    left = spark.createDataFrame(queries, "query_id string, fp16 array<array<double>>").select("query_id", normalized("fp16").alias("q_unit"))
    right = spark.createDataFrame(docs, "doc_id long, fp16 array<array<double>>").select("doc_id", normalized("fp16").alias("unit"))
    return left, right


@pytest.mark.parametrize(("k", "block", "tile"), [(1, 2000, 4096), (10, 5, 100), (30, 4, 4096), (1000, 2000, 300)])
def test_rows_scores_and_ties_are_those_of_the_expression(tables, k, block, tile):
    left, right = tables
    assert rows(dense.cosine_top(left, right, k, block, tile)) == rows(topk.against_all(left, right, lambda: cosine_maxsim("q_unit", "unit", unit=True), k))


def test_pairs_are_not_scored_one_by_one(tables):
    """No cross join: a block meets a tile as a whole."""
    left, right = tables
    plan = dense.cosine_top(left.where("query_id <> 'odd'"), right.where("doc_id < 704"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
