from pyspark.sql import functions as F
import json
import math
import random

import numpy as np
import pytest

from quillon.operators import metrics, quantiles, triage
from quillon.plans import harness
from quillon.sources import files, fixtures, reports


def test_ranking_by_hand(spark):
    hits = spark.createDataFrame([("q1", d, i) for i, d in enumerate("xayb", 1)] + [("q2", "z", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q1", "b"), ("q2", "n"), ("q3", "m")], "query_id string, doc_id string")
    got = {r.query_id: r for r in metrics.per_query(hits, qrels, 3).collect()}
    assert got["q1"].recall == pytest.approx(1 / 3) and got["q1"].reciprocal_rank == 0.5
    assert got["q1"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got["q2"].recall, got["q2"].ndcg, got["q2"].reciprocal_rank) == (0, 0, 0) == (got["q3"].recall, got["q3"].ndcg, got["q3"].reciprocal_rank)
    assert metrics.ranking(hits, qrels.limit(0)).first().asDict() == {"recall": 0.0, "ndcg": 0.0, "mrr": 0.0, "query_count": 0}


def test_percentiles(spark):
    frame = spark.createDataFrame([(float(x),) for x in range(1, 6)], "ms double")
    assert metrics.percentiles(frame, "ms").first().asDict() == {"p50": 3.0, "p95": 4.8}
    assert metrics.percentiles(frame.limit(0), "ms").first().asDict() == {"p50": 0.0, "p95": 0.0}


def brute_force(gold, pred):
    labels, n = sorted({*gold, *pred}), len(gold)
    per, weighted = {}, 0.0
    for x in labels:
        tp = sum(g == p == x for g, p in zip(gold, pred))
        precision, recall = (tp / pred.count(x) if x in pred else 0.0), (tp / gold.count(x) if x in gold else 0.0)
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        per[x], weighted = (gold.count(x), f1), weighted + f1 * gold.count(x) / n
    po, pe = sum(g == p for g, p in zip(gold, pred)) / n, sum(gold.count(x) * pred.count(x) for x in labels) / n**2
    return per, weighted, 1.0 if pe == 1 else (po - pe) / (1 - pe)


def test_classification_by_brute_force(spark):
    r = random.Random(3)
    for labels in ("ab", "abcd", "a"):
        gold, pred = [r.choice(labels) for _ in range(30)], [r.choice(labels + "e" * (len(labels) > 1)) for _ in range(30)]
        pairs = spark.createDataFrame(list(zip(gold, pred)), "gold string, pred string")
        per, weighted, kappa = brute_force(gold, pred)
        assert {x.label: (x.support, pytest.approx(x.f1)) for x in metrics.per_label(pairs).collect()} == per
        assert metrics.weighted_f1(pairs).first()[0] == pytest.approx(weighted) and metrics.cohens_kappa(pairs).first()[0] == pytest.approx(kappa)
        cells = {(x.gold, x.pred): x.n for x in metrics.confusion(pairs).collect()}
        assert cells == {(g, p): sum(a == g and b == p for a, b in zip(gold, pred)) for g in {*gold, *pred} for p in {*gold, *pred}}
    empty = pairs.limit(0)
    assert (metrics.weighted_f1(empty).first()[0], metrics.cohens_kappa(empty).first()[0]) == (0.0, 0.0)


def test_alignment(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "query_id string, label string")
    b = spark.createDataFrame([("1", "x"), ("3", "y")], "query_id string, label string")
    with pytest.raises(ValueError, match=r"missing=\['2'\] extra=\['3'\]"):
        metrics.aligned(a, b)
    assert metrics.aligned(a, a).count() == 2


def samples(spark, rows):
    return spark.createDataFrame(rows, f"query_id string, query_text string, evidence {triage.EVIDENCE}")


def test_rules_in_their_order(spark):
    hit = lambda i, t: (i, 1.0, "hybrid", t)
    rows = [
        ("q1", "Ransomware PHISHING", []), ("q2", "a beacon", [hit("e", "phishing")]), ("q3", "odd", [hit("e1", "credentials"), hit("e2", "Beacon"), hit("e3", "x")]),
        ("q4", "odd", [hit("e1", "Phishing")]), ("q5", "odd", [hit("e1", "quiet")]), ("q6", "odd", []),
    ]
    got = {r.query_id: r for r in triage.decide(samples(spark, rows)).collect()}
    assert [got[f"q{i}"].confidence for i in range(1, 7)] == [0.93, 0.96, 0.9, 0.88, 0.55, 0.55]
    assert got["q3"].cited_evidence_ids == ["e1", "e2"] and got["q6"].cited_evidence_ids == []
    assert (got["q2"].action, got["q2"].disposition) == ("isolate_host_and_block_beacon", "contain_host")


def judged(spark):
    rows = [("q1", "phishing", [("a", 1.0, "hybrid", "t"), ("b", 0.5, "hybrid", "t")]), ("q2", "none", [])]
    targets = spark.createDataFrame([("q1", "reset_credentials_and_scope_phishing", "credential_reset", ["a", "z"], "Credential"), ("q2", "x", "y", [], "keyword")], "query_id string, expected_action string, expected_disposition string, expected_evidence_ids array<string>, rationale_keyword string")
    return triage.judge(triage.decide(samples(spark, rows)).join(targets, "query_id"))


def test_judge_audit_and_gates(spark):
    got = {r.query_id: r for r in judged(spark).collect()}
    assert [got["q1"][s] for s in triage.SCORES] == [1.0, 0.5, 1.0, 0.93] and [got["q2"][s] for s in triage.SCORES] == pytest.approx([0, 0, 0, 0.45])
    done = triage.with_audit(judged(spark))
    kinds = done.where("query_id = 'q1'").first().audit_records
    assert [(r.kind, r.name) for r in kinds] == [("model_call", triage.TRIAGER), ("model_call", triage.JUDGE), ("tool_call", triage.TERMINAL_TOOL)]
    assert json.loads(kinds[0].inputs) == {"role": "triager", "query_text": "phishing", "retrieved_alert_ids": ["a", "b"]}
    names = [triage.TRIAGER, triage.JUDGE]
    assert tuple(triage.audit_summary(done, names=names, roles=["triager", "judge"]).first()) == (0, 0)
    assert tuple(triage.audit_summary(done, names=[*names, "third"], roles=["fourth"], tools=["other"]).first()) == (4, 2)
    assert tuple(triage.audit_summary(done, names=names, tools=[]).first()) == (0, 0)
    assert tuple(triage.gates(done, names=names).first()) == (True, True) and tuple(triage.gates(done.limit(0), names=names).first()) == (True, True)
    assert tuple(triage.gates(done, names=names, tool="other").first()) == (False, False)
    stray = triage.judge(triage.decide(samples(spark, [("q1", "phishing", [("a", 1.0, "hybrid", "t")])])).selectExpr("*", "'x' expected_action", "'y' expected_disposition", "array('a') expected_evidence_ids", "'k' rationale_keyword").withColumn("cited_evidence_ids", triage.F.array(triage.F.lit("a"), triage.F.lit("zz"))))
    assert stray.first().evidence_grounding == 0.0


def test_audit_records_as_variant(spark, tmp_path):
    """The same sums from VARIANT, also when stored, and the same records as text but for the order of keys."""
    text = triage.with_audit(judged(spark))
    triage.with_audit(judged(spark), variant=True).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    names = [triage.TRIAGER, triage.JUDGE]
    for wanted in ({"names": names, "roles": ["triager", "judge"]}, {"names": [*names, "third"], "roles": ["fourth"], "tools": ["other"]}):
        assert triage.audit_summary(stored, **wanted).first() == triage.audit_summary(text, **wanted).first()
    assert triage.gates(stored, names=names, roles=["triager"]).first() == triage.gates(text, names=names, roles=["triager"]).first()
    parsed = lambda frame: {r.query_id: [(a.kind, a.name, json.loads(a.inputs), json.loads(a.outputs)) for a in r.audit_records] for r in frame.collect()}
    assert parsed(triage.as_text(stored)) == parsed(text)


def test_replay_needs_every_sample(spark):
    own = samples(spark, [("q1", "t", []), ("q2", "t", [])])
    fixture = spark.createDataFrame([("q1", "act")], "query_id string, action string")
    with pytest.raises(ValueError, match="missing replay decision fixture for q2"):
        triage.replay(own, fixture)


def test_missing_text_raises(spark):
    hits = spark.createDataFrame([("q", "d", 1.0, 1, "bm25")], "query_id string, doc_id string, score double, rank int, stage string")
    with pytest.raises(KeyError):
        triage.attach_evidence(hits, spark.createDataFrame([], "id string, text string"))


@pytest.fixture
def folder(tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data))
    put("corpus_texts.json", {"d1": "Phishing mail with a credential form", "d2": "Beacon from a host", "d3": "Quiet printer"})
    put("query_texts.json", {"q1": "phishing credential mail", "q2": "host beacon"})
    put("qrels.json", {"q1": ["d1"], "q2": ["d2"]})
    put("analyst_labels.json", {"q1": "credential_reset", "q2": "contain_host"})
    target = lambda a, d, e, k: {"expected_action": a, "expected_disposition": d, "expected_evidence_ids": e, "rationale_keyword": k}
    put("reasoning_targets.json", {"q1": target("reset_credentials_and_scope_phishing", "credential_reset", ["d1"], "credential"), "q2": target("isolate_host_and_block_beacon", "contain_host", ["d2"], "beacon")})
    decision = lambda q, a, d, e: {"query_id": q, "query_text": "t", "action": a, "disposition": d, "confidence": 0.9, "rationale": "r", "cited_evidence_ids": e}
    scores = dict.fromkeys(triage.SCORES, 0.9)
    put("replay_runtime.json", {"llm_model": "replay:a", "judge_model": "replay:b", "samples": {q: {"decision": decision(q, "act", d, ["d1"]), "scores": scores} for q, d in (("q1", "credential_reset"), ("q2", "other"))}})
    return tmp_path


@pytest.fixture
def given(spark, folder):
    r = random.Random(4)
    vectors = {d: [[r.gauss(0, 1) for _ in range(48)] for _ in range(3)] for d in ("d1", "d2", "d3")}
    corpus = spark.createDataFrame(list(vectors.items()), "id string, fp16 array<array<float>>")
    queries = spark.createDataFrame([("q1", vectors["d1"][:2]), ("q2", vectors["d2"][1:])], "id string, fp16 array<array<float>>")
    return harness.Fixtures(spark, folder, corpus, queries)


def test_retrieval_runs(given, tmp_path):
    out = harness.retrieval_run(given, cache_state="cold", out_json=tmp_path / "r.json", out_latency=tmp_path / "l.csv")
    assert out["retrievers"] == list(harness.LANES) == list(json.loads((tmp_path / "r.json").read_text())["metrics"]) or set(out["metrics"]) == set(harness.LANES)
    assert all(m["recall@10"] == 1.0 and m["mrr"] == 1.0 for m in out["metrics"].values())
    assert {k for k, m in out["metrics"].items() if "rerank_ms" in m} == {"binary-then-fp16-rerank", "hybrid-bm25-then-fp16-rerank"}
    lines = (tmp_path / "l.csv").read_text().splitlines()
    assert lines[0] == "retriever,query_id,k,stage,latency_ms" and len(lines) == 11
    one = harness.exact_run(given, out_latency=tmp_path / "e.csv")
    assert one["metrics"]["ndcg@10"] == 1.0 and (tmp_path / "e.csv").read_text().startswith("retriever,query_id,k,latency_ms")
    pair = harness.paired_run(given, cache_state="warm", rerank_depth=2)
    assert pair["corpus_size"] == 3 and pair["binary_candidate_count"] == 2 and pair["fp16_p95_ms"] >= pair["fp16_p50_ms"] > 0
    for bad in ({"threads": 0}, {"cache_state": "tepid"}):
        with pytest.raises(ValueError):
            harness.retrieval_run(given, **bad)


def test_threads_and_uris(given, folder, tmp_path):
    out = harness.retrieval_run(given, ["bm25", "hamming-udf-bin"], threads=2, out_json=(tmp_path / "r.json").as_uri(), out_latency=(tmp_path / "l.csv").as_uri())
    assert out["thread_count"] == 2 and out["metrics"]["hamming-udf-bin"]["mrr"] == 1.0
    assert json.loads(files.read_text((tmp_path / "r.json").as_uri())) == json.loads((tmp_path / "r.json").read_text()) == out
    assert (tmp_path / "l.csv").read_text().splitlines()[0] == "retriever,query_id,k,stage,latency_ms"
    again = harness.Fixtures(given.spark, folder.as_uri(), given.corpus.withColumnRenamed("doc_id", "id"), given.queries.withColumnRenamed("query_id", "id"))
    assert again.qrels().count() == given.qrels().count() > 0


def test_exact_quantiles_without_a_buffer(spark):
    r = random.Random(6)
    groups = {0: [r.gauss(0, 1) for _ in range(501)], 1: [2.0] * 7, 2: [10.0 ** r.randrange(-300, 300) for _ in range(300)], 3: [1.0, 2.0]}
    frame = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [(0, None), (9, None)], "g int, x double").repartition(3)
    for small in (0, 10**6):
        got = quantiles.exact(frame, "g", "x", (0.0, 0.25, 0.5, 0.95, 1.0), small=small)
        assert got == {(g, s): pytest.approx(float(np.quantile(xs, s)), rel=1e-9) for g, xs in groups.items() for s in (0.0, 0.25, 0.5, 0.95, 1.0)}



def test_quantiles_read_their_input_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("x"))
    frame = rows.mapInPandas(counted, "g long, x double")
    got = quantiles.exact(frame, "g", "x", (0.1, 0.5, 0.99), small=10)
    assert read.value == 2 * 30_000
    want = rows.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q")).collect()
    assert got == {(r.g, s): pytest.approx(q) for r in want for s, q in zip((0.1, 0.5, 0.99), r.q)}


def test_quantiles_are_exact_where_brackets_miss(spark, monkeypatch):
    rows = spark.range(5_000).select(F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("double").alias("x"))
    want = rows.agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.97))).alias("q")).first().q
    for beyond in (-0.2, 0.0, 0.3):
        monkeypatch.setattr(quantiles, "BEYOND", beyond)
        got = quantiles.exact(rows, "g", "x", (0.5, 0.97), small=10)
        assert [got["a", 0.5], got["a", 0.97]] == pytest.approx(want)


def test_relevance_by_label_is_that_of_listed_pairs(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(k, r.randrange(4)) for k in range(40)], "doc_id long, label int")
    queries = spark.createDataFrame([(k, k % 5) for k in range(10)], "query_id long, label int")
    hits = spark.createDataFrame([(q, d, i + 1) for q in range(9) for i, d in enumerate(r.sample(range(40), 12))], "query_id long, doc_id long, rank int")
    listed = queries.where("label < 4").join(docs, "label").select("query_id", "doc_id")
    rows = lambda frame: sorted(tuple(round(x, 9) for x in row) for row in frame.collect())
    found = rows(metrics.per_query_by_label(hits, queries, docs, 5))
    assert [x for x in found if x[0] % 5 < 4] == rows(metrics.per_query(hits, listed, 5)) and [x[1:] for x in found if x[0] % 5 == 4] == [(0.0, 0.0, 0.0)] * 2


def test_too_many_labels_for_a_matrix_raise(spark):
    pairs = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "gold string, pred string")
    assert metrics.confusion(pairs).count() == 100
    with pytest.raises(ValueError, match="10 labels"):
        metrics.confusion(pairs, most=9)


def test_retrieval_gates_and_boundary_ties(spark):
    report = {"metrics": {"lance-mv": {"p50_ms": 8.0, "ndcg@10": 0.9}, "hamming-udf-bin": {"p50_ms": 2.0}, "binary-then-fp16-rerank": {"ndcg@10": 0.87}}}
    assert harness.retrieval_gates(report) == {"g_retrieval_speed": True, "g_retrieval_quality": False}
    scored = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), ("a", 1.0, 3), ("b", 2.0, 1), ("b", 1.0, 2)], "query_id string, score double, rank int")
    assert {r.query_id: r.tied for r in metrics.boundary_ties(scored, 2).collect()} == {"a": True, "b": False}


def test_reasoning_and_disposition_runs(spark, given, folder, tmp_path):
    out = harness.reasoning_run(given, out_json=tmp_path / "t2.json", out_trace=tmp_path / "trace.jsonl")
    assert out["metrics"] == pytest.approx({"action_validity": 1.0, "evidence_grounding": 1.0, "specificity": 1.0, "calibration": 0.945})
    assert out["gate_results"] == {"g_agent_terminality": True, "g_auditability": True} and out["audit_summary"] == {"orphan_llm_calls": 0, "orphan_tool_calls": 0}
    trace = [json.loads(x) for x in (tmp_path / "trace.jsonl").read_text().splitlines()]
    assert len(trace) == 2 and [r["kind"] for r in trace[0]["audit_records"]] == ["model_call", "model_call", "tool_call"]
    done = harness.disposition_run(spark, folder / "analyst_labels.json", tmp_path / "t2.json", out_json=tmp_path / "t3.json")
    assert done["metrics"] == {"weighted_f1": 1.0, "cohens_kappa": 1.0} and done["per_label"]["contain_host"] == {"support": 1, "f1": 1.0}
    twice = json.loads((tmp_path / "t2.json").read_text())
    twice["samples"] *= 2
    (tmp_path / "t2x.json").write_text(json.dumps(twice))
    with pytest.raises(ValueError, match="duplicate query_id"):
        harness.disposition_run(spark, folder / "analyst_labels.json", tmp_path / "t2x.json")


def test_replay_run(given, folder):
    out = harness.reasoning_run(given, runtime="replay", runtime_fixture=folder / "replay_runtime.json")
    assert out["llm_model"] == "replay:a" and out["metrics"]["calibration"] == pytest.approx(0.9) and out["samples"][1]["disposition"] == "other"
    assert out["samples"][0]["query_text"] == "phishing credential mail"
    with pytest.raises(ValueError, match="requires a runtime fixture"):
        harness.reasoning_run(given, runtime="replay")


def test_fixture_files(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "c.npz", doc_ids=np.array(["a", "b"]), doc_tokens=np.ones((2, 3, 4), np.float32))
    got = fixtures.token_matrices(spark, str(tmp_path / "c.npz"), "doc").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].fp16 == [[1.0] * 4] * 3
    (tmp_path / "bad.json").write_text('{"q": {"expected_action": "a"}}')
    with pytest.raises(Exception, match="incomplete reasoning target"):
        fixtures.reasoning_targets(spark, str(tmp_path / "bad.json")).collect()
    reports.write_latency_table(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()[0] == "1"


def test_task_times_and_the_kernel_alone(spark, tmp_path):
    from quillon.functions.kernels import hamming_maxsim
    from quillon.plans import timing

    spark.range(5_000).write.parquet(str(tmp_path / "t"))
    found = timing.of_tasks(spark, lambda: spark.read.parquet(str(tmp_path / "t")).groupBy((F.col("id") % 7).alias("k")).count().collect())
    assert found.rows_read == 5_000 and found.run_ms >= 0 and found.cpu_ms > 0 and len(found.stages) >= 2
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    docs = spark.range(20_000).select(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("bin"))
    queries = spark.range(8).select(F.array(*(F.xxhash64("id", F.lit(k)) for k in range(6))).alias("q_bin"))
    ms, n = timing.kernel_ms(queries, docs, lambda: hamming_maxsim("q_bin", "bin"), ["q_bin", "bin"])
    assert n == 160_000 and ms > 0
