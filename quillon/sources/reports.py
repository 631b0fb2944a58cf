"""Sinks: JSON reports, latency tables and traces."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources import files


def write_report(report: Mapping, path: str | Path) -> None:
    """Indented JSON with sorted keys; as the other files here, at a local path or a URI that Spark reaches."""
    files.write_text(path, json.dumps(report, indent=2, sort_keys=True) + "\n")


def write_latencies(rows: Sequence[Mapping], path: str | Path, *, staged: bool = False) -> None:
    """A CSV table of retriever, query_id, k, (stage,) latency_ms."""
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, ["retriever", "query_id", "k", *(["stage"] if staged else []), "latency_ms"])
    writer.writeheader()
    writer.writerows(rows)
    files.write_text(path, out.getvalue())


def write_latency_table(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def trace_lines(samples: DataFrame) -> DataFrame:
    """(value): one JSON object a sample, with its columns in order of name, for write.text at scale."""
    return samples.select(F.to_json(F.struct(*sorted(samples.columns))).alias("value"))


def write_trace(samples: DataFrame, path: str | Path) -> None:
    """The trace as one file of JSON lines, sorted by query_id. Samples come one at a time; at a URI, Spark writes a
    folder of such files instead, each sorted."""
    if files.is_uri(path):
        trace_lines(samples.orderBy("query_id")).write.mode("overwrite").text(str(path))
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as out:
        for row in samples.orderBy("query_id").toLocalIterator():
            out.write(json.dumps(sample_dict(row), sort_keys=True) + "\n")


def sample_dict(row) -> dict:
    """A sample's row as plain data; records' JSON is parsed."""
    plain = row.asDict(recursive=True)
    for record in plain.get("audit_records", []):
        record["inputs"], record["outputs"] = json.loads(record["inputs"]), json.loads(record["outputs"])
    return plain
