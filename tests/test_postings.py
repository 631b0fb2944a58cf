import random

import pytest

from quillon.operators import bm25, postings, topk


def corpus(seed, n):
    """Frequent words everywhere, rare ones in a few documents, one rare word often in a stretch of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.choices(["the", "of", "a1", "b2", "c3", "d4", "e5", "f6"], (20, 10, 6, 4, 2, 2, 1, 1), k=r.randrange(3, 60))
        if 40 <= i < 48:
            words += ["rare"] * r.randrange(1, 9)
        rows.append((i * 3, None if i % 97 == 5 else "" if i % 97 == 6 else " ".join(words)))
    return rows


QUERIES = [("q1", "the rare"), ("q2", "of a1 a1 b2"), ("q3", "f6"), ("q4", "rare"), ("q5", "unknown words"), ("q6", "!!"), ("q7", "the of a1 b2 c3 d4 e5 f6 rare")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(corpus(1, 700), "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame(QUERIES, "query_id string, text string")


def rows(frame):
    return sorted((r.query_id, r.doc_id, r.score, r.matched_terms, r["rank"] if "rank" in frame.columns else 0) for r in frame.collect())


@pytest.mark.parametrize(("block", "bucket", "probed"), [(4, 32, 1), (64, 1024, 4), (1, 1, 2)])
def test_top_equals_all_scores(spark, tables, block, bucket, probed):
    docs, queries = tables
    index = postings.build(docs, block=block, bucket=bucket)
    want = bm25.scores(docs, queries)
    assert rows(postings.scores(index, queries)) == rows(want)
    for k in (1, 10) if block == 4 else (10,):
        assert rows(postings.top(index, queries, k, probed=probed)) == rows(topk.ranked(want, k))


def test_blocks_are_skipped(spark, tables):
    docs, queries = tables
    index = postings.build(docs, block=4, bucket=32)
    read = {r.query_id: (r.blocks, r.read) for r in postings.blocks_read(index, queries, 5).collect()}
    assert set(read) == {"q1", "q2", "q3", "q4", "q7"} and all(0 < b <= a for a, b in read.values())
    assert read["q1"][1] * 4 < read["q1"][0]  # the rare word decides


def test_blocks_by_plain_python(spark, tables):
    docs, _ = tables
    index = postings.build(docs, block=4, bucket=32)
    want = {}
    for doc, text in sorted(corpus(1, 700)):
        words = (text or "").split()
        for term in set(words):
            want.setdefault((term, doc // 32), []).append((doc % 32, words.count(term), len(words)))
    got = {}
    for r in index.postings().collect():
        assert r.n == len(r.at) == len(r.tf) == len(r.length) <= 4
        each = list(zip(r.at, r.tf, r.length))
        best = {(tf, n) for _, tf, n in each if not any((a > tf and b <= n) or (a >= tf and b < n) for _, a, b in each)}
        assert {(i.tf, i.length) for i in r.impacts} == best
        got.setdefault((r.term, r.bucket), []).append((r.block, each))
    assert {k: [x for _, own in sorted(v) for x in own] for k, v in got.items()} == want


def test_ids_as_text_and_negative_ids(spark, tables):
    docs, queries = tables
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS doc", "2 AS at")
    assert rows(postings.top(postings.build(named), queries, 6)) == rows(topk.ranked(bm25.scores(named, queries), 6))
    moved = docs.selectExpr("doc_id - 1000 AS doc_id", "text")
    assert rows(postings.top(postings.build(moved, bucket=64), queries, 6)) == rows(topk.ranked(bm25.scores(moved, queries), 6))


def test_empty_corpus_and_many_terms(spark, tables, monkeypatch):
    docs, queries = tables
    assert postings.top(postings.build(docs.limit(0)), queries, 3).collect() == []
    index = postings.build(docs)
    assert index.corpus().first().n_docs == 700
    monkeypatch.setattr(bm25, "LITERAL_TERMS", 1)
    assert rows(postings.top(index, queries, 3)) == rows(topk.ranked(bm25.scores(docs, queries), 3))
    with pytest.raises(ValueError, match="k must be >= 1"):
        postings.top(index, queries, 0)


def test_texts_are_shuffled_and_not_postings(spark):
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    rows = corpus(1, 700)
    before = shuffled()
    postings.build(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = sum(len(set((text or "").split())) for _, text in rows)
    assert shuffled() - before < 2 * len(rows) < pairs  # the texts, and the counts of nine terms
