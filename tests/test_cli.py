import json
import sys

import numpy as np
import pytest

from quillon.__main__ import main
from tests.test_evaluation import folder  # noqa: F401
from tests.test_runtime import server  # noqa: F401


@pytest.fixture
def packed(spark, folder):  # noqa: F811
    r = np.random.default_rng(5)
    docs = r.normal(size=(3, 3, 48)).astype(np.float32)
    np.savez(folder / "corpus_fp16.npz", doc_ids=np.array(["d1", "d2", "d3"]), doc_tokens=docs)
    np.savez(folder / "queries_fp16.npz", query_ids=np.array(["q1", "q2"]), query_tokens=docs[:2, :2])
    return folder


def test_runs(packed, tmp_path, server):  # noqa: F811
    at = ["--fixture-dir", str(packed)]
    assert main(["exact", *at, "--out-json", str(tmp_path / "e.json")])["metrics"]["mrr"] == 1.0 and (tmp_path / "e.json").exists()
    assert set(main(["lanes", *at, "--cache-state", "cold"])["metrics"]) >= {"bm25", "hamming-udf-bin"}
    command = server("ok")
    out = main(["reasoning", *at, "--out-json", str(tmp_path / "t2.json"), "--terminal-runtime", "mcp", "--mcp-server-command", " ".join(command[:2]), *(f"--mcp-server-arg={a}" for a in command[2:])])
    assert out["gate_results"] == {"g_agent_terminality": True, "g_auditability": True} and out["samples"][0]["audit_records"][2]["outputs"]["content"]
    assert main(["disposition", *at, "--tier2-json", str(tmp_path / "t2.json")])["metrics"]["weighted_f1"] == 1.0
    replay = main(["reasoning", *at, "--runtime", "replay", "--runtime-fixture", str(packed / "replay_runtime.json")])
    assert replay["llm_model"] == "replay:a" and json.dumps(replay)
    with pytest.raises(ValueError, match="requires a server command"):
        main(["reasoning", *at, "--terminal-runtime", "mcp"])


def test_probe(server):  # noqa: F811
    command = server("ok")
    out = main(["probe", "--mcp-server-command", sys.executable, *(f"--mcp-server-arg={a}" for a in command[1:])])
    assert out["tool"] == "echo" and out["result"]["content"][0]["text"] == "Echo: hello"
