"""One triage sample at a time, for runtimes whose decisions come from outside Spark.

Such calls have side effects, so they run once each on the driver, never inside a plan that may be computed again. What
they give is appended to a table in the shared folder in batches, so the driver holds one batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import batched
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import triage
from quillon.sources import files

#: Samples that the driver holds before it writes them.
BATCH = 500


@dataclass(frozen=True)
class Evidence:
    alert_id: str
    score: float
    stage: str
    text: str


@dataclass(frozen=True)
class Decision:
    query_id: str
    query_text: str
    action: str
    disposition: str
    confidence: float
    rationale: str
    cited_evidence_ids: tuple[str, ...]

    @classmethod
    def of(cls, payload: Mapping) -> Decision:
        """A decision of exactly these fields, each of its type; else ValueError."""
        kinds = {"query_id": str, "query_text": str, "action": str, "disposition": str, "confidence": (int, float), "rationale": str, "cited_evidence_ids": (list, tuple)}
        if set(payload) != set(kinds):
            raise ValueError(f"decision fields differ: {sorted(set(payload) ^ set(kinds))}")
        for name, kind in kinds.items():
            if not isinstance(payload[name], kind) or isinstance(payload[name], bool):
                raise ValueError(f"decision field {name} has the wrong type")
        if not all(isinstance(x, str) for x in payload["cited_evidence_ids"]):
            raise ValueError("decision field cited_evidence_ids has the wrong type")
        return cls(**{**payload, "confidence": float(payload["confidence"]), "cited_evidence_ids": tuple(payload["cited_evidence_ids"])})

    def plain(self) -> dict:
        return {**asdict(self), "cited_evidence_ids": list(self.cited_evidence_ids)}


@dataclass(frozen=True)
class Record:
    kind: str
    name: str
    inputs: dict
    outputs: dict


class Triager(Protocol):
    model_id: str

    def decide(self, query_id: str, query_text: str, evidence: Sequence[Evidence]) -> tuple[Decision, Record]: ...


class Judge(Protocol):
    model_id: str

    def evaluate(self, query_id: str, query_text: str, decision: Decision, evidence: Sequence[Evidence], target: Mapping) -> tuple[dict[str, float], Record]: ...


class Tool(Protocol):
    tool_name: str

    def emit(self, query_id: str, query_text: str, decision: Decision) -> Record: ...


class LocalTool:
    """The terminal tool that only records the decision."""

    tool_name = triage.TERMINAL_TOOL

    def emit(self, query_id: str, query_text: str, decision: Decision) -> Record:
        outputs = {"action": decision.action, "disposition": decision.disposition, "cited_evidence_ids": list(decision.cited_evidence_ids)}
        return Record("tool_call", self.tool_name, {"query_id": query_id, "query_text": query_text}, outputs)

    def close(self) -> None: ...


SAMPLE_SCHEMA = (
    f"query_id string, query_text string, evidence {triage.EVIDENCE}, action string, disposition string, confidence double, rationale string, cited_evidence_ids array<string>, "
    + ", ".join(f"{s} double" for s in triage.SCORES)
    + ", retrieved_alert_ids array<string>, terminal_output_kind string, terminal_tool string, audit_records array<struct<kind: string, name: string, inputs: string, outputs: string>>"
)


def run(spark: SparkSession, samples: DataFrame, triager: Triager, judge: Judge, tool: Tool) -> DataFrame:
    """Decide, judge and emit for each row of samples with its target's columns, in order of query_id.

    The rows come to the driver one at a time; the result has the columns of the column-wise operators.
    """
    return appended(spark, _run(samples, triager, judge, tool), SAMPLE_SCHEMA)


def appended(spark: SparkSession, rows: Iterable[tuple], schema: str, batch: int = BATCH) -> DataFrame:
    """A table of rows, written ``batch`` at a time."""
    folder = files.new_folder(spark, "samples")
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    for part in batched(rows, batch):
        spark.createDataFrame(list(part), schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _run(samples: DataFrame, triager: Triager, judge: Judge, tool: Tool) -> Iterator[tuple]:
    for row in samples.orderBy("query_id").toLocalIterator():
        evidence = [Evidence(**e.asDict()) for e in row["evidence"] or []]
        decision, first = triager.decide(row["query_id"], row["query_text"], evidence)
        scores, second = judge.evaluate(row["query_id"], row["query_text"], decision, evidence, row.asDict())
        third = tool.emit(row["query_id"], row["query_text"], decision)
        records = [(r.kind, r.name, json.dumps(r.inputs), json.dumps(r.outputs)) for r in (first, second, third)]
        yield (row["query_id"], row["query_text"], [tuple(asdict(e).values()) for e in evidence], decision.action, decision.disposition, decision.confidence, decision.rationale, list(decision.cited_evidence_ids), *(float(scores[s]) for s in triage.SCORES), [e.alert_id for e in evidence], "tool_call", tool.tool_name, records)
