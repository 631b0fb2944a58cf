"""Fixtures: JSON maps, targets, replays and token matrices, as tables with fixed schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import npz

TARGET = "struct<expected_action: string, expected_disposition: string, expected_evidence_ids: array<string>, rationale_keyword: string>"
DECISION = "struct<query_id: string, query_text: string, action: string, disposition: string, confidence: double, rationale: string, cited_evidence_ids: array<string>>"
REPLAY = f"struct<llm_model: string, judge_model: string, samples: map<string, struct<decision: {DECISION}, scores: map<string, double>>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with column j, the file parsed by the schema; what does not fit raises."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))


def text_map(spark: SparkSession, path: str, value: str = "text", key: str = "id") -> DataFrame:
    """(id, text) of a JSON object of strings."""
    return _json(spark, path, "map<string, string>").select(F.explode("j").alias(key, value))


def analyst_labels(spark: SparkSession, path: str) -> DataFrame:
    return text_map(spark, path, "label", "query_id")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of a JSON object of lists."""
    return _json(spark, path, "map<string, array<string>>").select(F.explode("j").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id"))


def reasoning_targets(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, expected_action, ...), each target whole."""
    rows = _json(spark, path, f"map<string, {TARGET}>").select(F.explode("j").alias("query_id", "t")).select("query_id", "t.*")
    checked = F.when(F.col("expected_action").isNull() | F.col("expected_disposition").isNull() | F.col("expected_evidence_ids").isNull() | F.col("rationale_keyword").isNull(), F.raise_error(F.concat(F.lit("incomplete reasoning target: "), "query_id")).cast("string")).otherwise(F.col("query_id"))
    return rows.withColumn("query_id", checked)


def replay_fixture(spark: SparkSession, path: str) -> tuple[str, str, DataFrame, DataFrame]:
    """(triager model, judge model, decisions by query_id, scores by query_id)."""
    whole = _json(spark, path, REPLAY)
    models = whole.select("j.llm_model", "j.judge_model").first()
    each = whole.select(F.explode("j.samples").alias("query_id", "s"))
    decisions = each.select("query_id", *(f"s.decision.{c}" for c in ("action", "disposition", "confidence", "rationale", "cited_evidence_ids")))
    scores = each.select("query_id", *(F.element_at("s.scores", F.lit(c)).alias(c) for c in ("action_validity", "evidence_grounding", "specificity", "calibration")))
    return models["llm_model"], models["judge_model"], decisions, scores


def token_matrices(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, fp16) of .npz files with {kind}_ids and {kind}_tokens, read by the executors without pickle: a single archive that
    all machines see by ranges of rows, others whole, one in a task."""
    at = npz.local(path)
    if at is not None and Path(at).is_file():
        return npz.matrices(spark, path, kind)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    ids, tokens = data[f"{kind}_ids"], data[f"{kind}_tokens"]
                for k in range(0, len(ids), 1000):
                    yield pd.DataFrame({"id": [str(i) for i in ids[k : k + 1000]], "fp16": [np.asarray(t, np.float32).tolist() for t in tokens[k : k + 1000]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "id string, fp16 array<array<float>>")
