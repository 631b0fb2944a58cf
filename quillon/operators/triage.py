"""Rule-based and replayed triage, judging and audit, as columns.

A sample is a row: query_id, query_text and evidence, an array of (alert_id, score, stage, text) in rank order. A
decision adds the columns of DECISION; a judgement adds those of SCORES.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = "array<struct<alert_id: string, score: double, stage: string, text: string>>"
DECISION = ("action", "disposition", "confidence", "rationale", "cited_evidence_ids")
SCORES = ("action_validity", "evidence_grounding", "specificity", "calibration")
TRIAGER, JUDGE = "local:deterministic-triager-v1", "local:deterministic-judge-v1"
TERMINAL_TOOL = "propose_investigation_step"

# The rules in their order. (where to look, words, action, disposition, confidence, rationale)
_CREDENTIALS = ("phishing", "credential")
_HOST = ("ransomware", "beacon")
RULES = (
    ("query", _CREDENTIALS, "reset_credentials_and_scope_phishing", "credential_reset", 0.93, "Phishing credential evidence supports a scoped credential reset investigation."),
    ("query", _HOST, "isolate_host_and_block_beacon", "contain_host", 0.96, "Ransomware beacon evidence requires host containment before deeper investigation."),
    ("evidence", _HOST, "isolate_host_and_block_beacon", "contain_host", 0.9, "Retrieved ransomware beacon evidence points to containment as the next investigation step."),
    ("evidence", _CREDENTIALS, "reset_credentials_and_scope_phishing", "credential_reset", 0.88, "Retrieved phishing credential evidence supports a scoped credential reset investigation."),
)
OTHERWISE = ("collect_more_context", "needs_triage", 0.55, "The retrieved evidence is not specific enough yet, so the next step is bounded investigation.")


def decide(samples: DataFrame) -> DataFrame:
    """The first rule with a word in the query, or in the evidence's texts. Cites the first two hits."""
    places = {"query": F.lower("query_text"), "evidence": F.lower(F.concat_ws(" ", F.transform("evidence", lambda e: e["text"])))}
    chosen = F.lit(len(RULES))
    for k in reversed(range(len(RULES))):
        where, said = RULES[k][:2]
        hit = F.coalesce(places[where].contains(said[0]) | places[where].contains(said[1]), F.lit(False))
        chosen = F.when(hit, F.lit(k)).otherwise(chosen)
    outcomes = [r[2:] for r in RULES] + [OTHERWISE]
    of = lambda i: F.element_at(F.array(*(F.lit(o[i]) for o in outcomes)), F.col("_rule") + 1)
    out = samples.withColumn("_rule", chosen)
    for i, name in enumerate(DECISION[:4]):
        out = out.withColumn(name, of(i).cast("double") if name == "confidence" else of(i))
    return out.withColumn("cited_evidence_ids", F.transform(F.slice("evidence", 1, 2), lambda e: e["alert_id"])).drop("_rule")


def judge(decided: DataFrame) -> DataFrame:
    """Scores of decisions against the columns expected_action, expected_disposition, expected_evidence_ids, rationale_keyword."""
    cited, expected = F.col("cited_evidence_ids"), F.col("expected_evidence_ids")
    retrieved = F.transform("evidence", lambda e: e["alert_id"])
    grounded = F.size(F.filter(cited, lambda c: F.array_contains(expected, c))).cast("double")
    stray = F.size(F.array_except(cited, retrieved)) > 0
    right_action = F.col("action") == F.col("expected_action")
    correct = F.when(right_action & (F.col("disposition") == F.col("expected_disposition")), 1.0).otherwise(0.0)
    keyword = F.lower("rationale").contains(F.lower("rationale_keyword"))
    return (
        decided.withColumn("action_validity", F.when(right_action, 1.0).otherwise(0.0))
        .withColumn("evidence_grounding", F.when((F.size(expected) == 0) | stray, 0.0).otherwise(grounded / F.size(expected)))
        .withColumn("specificity", F.when(keyword & (F.size(cited) > 0), 1.0).otherwise(0.0))
        .withColumn("calibration", F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("confidence") - correct)))
    )


def replay(samples: DataFrame, fixture: DataFrame, kind: str = "decision") -> DataFrame:
    """Decisions or scores of a fixture by query_id; a sample without one raises. The samples' own columns stay."""
    lone = samples.select("query_id").join(fixture.select("query_id"), "query_id", "left_anti").orderBy("query_id").first()
    if lone is not None:
        raise ValueError(f"missing replay {kind} fixture for {lone['query_id']}")
    wanted = [c for c in fixture.columns if c == "query_id" or c not in samples.columns]
    return samples.join(fixture.select(*wanted), "query_id")


def _record(kind: str, name: str, inputs: Column, outputs: Column, variant: bool) -> Column:
    as_ = F.to_variant_object if variant else F.to_json
    return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), as_(inputs).alias("inputs"), as_(outputs).alias("outputs"))


def with_audit(judged: DataFrame, *, triager: str = TRIAGER, judge_name: str = JUDGE, tool: str = TERMINAL_TOOL, variant: bool = False) -> DataFrame:
    """Add retrieved_alert_ids, the terminal fields and the three audit records: triager, judge, tool, in this order.

    inputs and outputs of a record are JSON objects, as text or as VARIANT, whose fields are read without parsing.
    """
    ids = F.transform("evidence", lambda e: e["alert_id"]).alias("retrieved_alert_ids")
    decision = F.struct("query_id", "query_text", *DECISION)
    records = F.array(
        _record("model_call", triager, F.struct(F.lit("triager").alias("role"), "query_text", ids), decision, variant),
        _record("model_call", judge_name, F.struct(F.lit("judge").alias("role"), "query_id", "query_text", ids), F.struct(*SCORES), variant),
        _record("tool_call", tool, F.struct("query_id", "query_text"), F.struct("action", "disposition", "cited_evidence_ids"), variant),
    )
    return judged.withColumn("retrieved_alert_ids", ids).withColumn("terminal_output_kind", F.lit("tool_call")).withColumn("terminal_tool", F.lit(tool)).withColumn("audit_records", records)


def as_text(samples: DataFrame) -> DataFrame:
    """Samples whose records' inputs and outputs are VARIANT with these as JSON text, their keys in order."""
    text = lambda r: F.struct(r["kind"].alias("kind"), r["name"].alias("name"), F.to_json(r["inputs"]).alias("inputs"), F.to_json(r["outputs"]).alias("outputs"))
    return samples.withColumn("audit_records", F.transform("audit_records", text))


def audit_summary(samples: DataFrame, *, names: Sequence[str], roles: Sequence[str] | None = None, tools: Sequence[str] | None = None) -> DataFrame:
    """One row: orphan_llm_calls and orphan_tool_calls, the expected names and roles missing, summed over samples."""
    tools = list(tools) if tools else [TERMINAL_TOOL]
    inputs = samples.schema["audit_records"].dataType.elementType["inputs"].dataType
    role = (lambda r: F.try_variant_get(r["inputs"], "$.role", "string")) if isinstance(inputs, T.VariantType) else (lambda r: F.get_json_object(r["inputs"], "$.role"))
    strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    of_kind = lambda kind: F.filter("audit_records", lambda r: r["kind"] == kind)
    missing = F.size(F.array_except(strings(sorted(set(names))), F.transform(of_kind("model_call"), lambda r: r["name"])))
    if roles is not None:
        missing = missing + F.size(F.array_except(strings(sorted(set(roles))), F.transform(of_kind("model_call"), role)))
    missing_tools = F.size(F.array_except(strings(sorted(set(tools))), F.transform(of_kind("tool_call"), lambda r: r["name"])))
    return samples.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("orphan_llm_calls"), F.coalesce(F.sum(missing_tools), F.lit(0)).alias("orphan_tool_calls"))


def gates(samples: DataFrame, *, names: Sequence[str], roles: Sequence[str] | None = None, tool: str = TERMINAL_TOOL) -> DataFrame:
    """One row: g_agent_terminality and g_auditability; both hold where there are no samples."""
    last = F.element_at("audit_records", -1)
    ends = (last["kind"] == "tool_call") & (last["name"] == tool) & (F.col("terminal_output_kind") == "tool_call") & (F.col("terminal_tool") == tool)
    terminal = samples.agg(F.coalesce(F.bool_and(F.coalesce(ends, F.lit(False))), F.lit(True)).alias("g_agent_terminality"))
    orphans = audit_summary(samples, names=names, roles=roles, tools=[tool])
    return terminal.crossJoin(orphans.select(((F.col("orphan_llm_calls") == 0) & (F.col("orphan_tool_calls") == 0)).alias("g_auditability")))  # one row each


def mean_scores(judged: DataFrame) -> DataFrame:
    """One row of the means of SCORES; zeros without samples."""
    return judged.agg(*(F.coalesce(F.avg(s), F.lit(0.0)).alias(s) for s in SCORES))


def attach_evidence(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, evidence) of hits(query_id, doc_id, score, rank, stage) with texts(id, text); a missing text raises."""
    lone = hits.join(texts, hits.doc_id == texts.id, "left_anti").select("doc_id").first()
    if lone is not None:
        raise KeyError(str(lone["doc_id"]))
    each = hits.join(texts, hits.doc_id == texts.id).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("alert_id"), F.col("score").cast("double").alias("score"), "stage", "text"))).alias("own"))
    return each.select("query_id", F.transform("own", lambda e: F.struct(e["alert_id"].alias("alert_id"), e["score"].alias("score"), e["stage"].alias("stage"), e["text"].alias("text"))).alias("evidence"))
