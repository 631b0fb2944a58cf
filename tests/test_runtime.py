import json
import sys
import textwrap

import pytest

from quillon.operators import triage
from quillon.runtime import mcp, providers, retry
from quillon.runtime.samples import Decision, Evidence, LocalTool, run

EVIDENCE = [Evidence("d1", 1.0, "hybrid", "text")]
DECISION = {"query_id": "q", "query_text": "t", "action": "a", "disposition": "d", "confidence": 0.5, "rationale": "r", "cited_evidence_ids": ["d1"]}
SCORES = dict.fromkeys(triage.SCORES, 0.5)
TARGET = {"expected_action": "a", "expected_disposition": "d", "expected_evidence_ids": ["d1"], "rationale_keyword": "k"}


def test_retry_waits_and_gives_up():
    slept, said, tries = [], [], []

    def fails():
        tries.append(1)
        raise KeyError(len(tries))

    policy = retry.RetryPolicy(3, 0.25, 0, 2.0)
    with pytest.raises(KeyError, match="3"):
        retry.call(fails, policy, lambda e: True, on_retry=lambda e, n, d: said.append((n, d)), sleep=slept.append)
    assert slept == [0.25, 0.5] and said == [(2, 0.25), (3, 0.5)]
    with pytest.raises(KeyError, match="4"):
        retry.call(fails, policy, lambda e: False)
    assert retry.RetryPolicy(5, 1, 1.5, 2).delay_before_attempt(4) == 1.5 and policy.delay_before_attempt(1) == 0.0
    for bad in ({"max_attempts": 0}, {"initial_backoff_seconds": -1}, {"max_backoff_seconds": -1}, {"backoff_multiplier": 0.5}):
        with pytest.raises(ValueError, match=f"retry {next(iter(bad))} must be >="):
            retry.RetryPolicy(**bad)


class Fake:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def post_json(self, **call):
        self.calls.append(call)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def openai(tool, payload):
    return {"id": "r1", "output": [{"type": "reasoning"}, {"type": "function_call", "name": tool, "arguments": json.dumps(payload)}]}


def anthropic(tool, payload):
    return {"id": "r1", "content": [{"type": "text"}, {"type": "tool_use", "name": tool, "input": payload}]}


@pytest.mark.parametrize(("name", "answer", "path"), [("openai", openai, "/responses"), ("anthropic", anthropic, "/messages")])
def test_hosted_calls(name, answer, path):
    fake = Fake(answer("emit_triage_decision", DECISION), answer("emit_reasoning_scores", SCORES))
    runtime = providers.HostedRuntime(name, model_id="m", api_key="k", api_base_url="http://x/v1/", transport=fake)
    decision, record = runtime.decide("q", "t", EVIDENCE)
    assert decision == Decision.of(DECISION) and record.name == f"{name}:m" and record.outputs["response_id"] == "r1"
    scores, record = runtime.evaluate("q", "t", decision, EVIDENCE, TARGET)
    assert scores == SCORES and record.inputs["role"] == "judge" and record.inputs["provider"] == name
    first = fake.calls[0]
    assert first["url"] == f"http://x/v1{path}" and first["payload"]["model"] == "m" and "The case, as JSON" in json.dumps(first["payload"])
    if name == "openai":
        assert first["payload"]["store"] is False and first["payload"]["tools"][0]["strict"] is True and first["headers"]["Authorization"] == "Bearer k"
    else:
        assert first["payload"]["max_tokens"] == 512 and first["payload"]["tool_choice"] == {"type": "tool", "name": "emit_triage_decision"} and first["headers"]["x-api-key"] == "k"


def test_hosted_retries_and_errors(monkeypatch):
    busy = providers.ProviderError("busy", code="provider_http_error", retryable=True, status_code=429)
    make = lambda *a, **o: providers.HostedRuntime("openai", api_key="k", transport=Fake(*a), **o)
    assert make(busy, openai("emit_triage_decision", DECISION), retry_policy=retry.RetryPolicy(2)).decide("q", "t", [])[0].action == "a"
    with pytest.raises(providers.ProviderError):
        make(busy).decide("q", "t", [])
    final = providers.ProviderError("no", code="provider_http_error", retryable=False, status_code=401)
    with pytest.raises(providers.ProviderError, match="no"):
        make(final, openai("emit_triage_decision", DECISION), retry_policy=retry.RetryPolicy(3)).decide("q", "t", [])
    for bad in ({}, {"output": []}, openai("other", {}), openai("emit_triage_decision", [1]), openai("emit_triage_decision", {**DECISION, "more": 1}), openai("emit_triage_decision", {**DECISION, "action": 3})):
        with pytest.raises(ValueError):
            make(bad).decide("q", "t", [])
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)
    with pytest.raises(ValueError, match="set ANTHROPIC_API_KEY"):
        providers.HostedRuntime("anthropic")
    monkeypatch.setenv("OTHER_KEY", "v")
    assert providers.HostedRuntime("anthropic", api_key_env="OTHER_KEY").api_key == "v"
    with pytest.raises(ValueError, match="write openai:<model>"):
        make(model_id="anthropic:m")
    with pytest.raises(ValueError, match="unsupported provider"):
        providers.HostedRuntime("other")


SERVER = textwrap.dedent(
    """
    import json, os, sys, time
    mode, mark = sys.argv[1], sys.argv[2]
    first = not os.path.exists(mark)
    open(mark, "a").write("x")
    for line in sys.stdin:
        m = json.loads(line)
        if "id" not in m or m["method"] == "shutdown":
            continue
        if m["method"] == "initialize":
            if mode == "slow-start" and first: time.sleep(5)
            r = {"protocolVersion": "2025-03-26"} if mode != "bad-protocol" else {}
        elif m["method"] == "tools/list":
            r = {"tools": [{"name": n} for n in ("propose_investigation_step", "echo")] if mode != "no-tool" else [{"name": "x"}]}
            if mode == "bad-tools": r = {"tools": [1]}
        else:
            if mode == "slow-call" and first: time.sleep(5)
            if mode == "dies" and first: sys.exit(0)
            a = m["params"]["arguments"]
            text = "Echo: " + a.get("message", "ok")
            if mode == "bad-echo": text = "no json"
            if mode == "list-echo": text = "[1]"
            if mode == "shape-echo": text = '{"action": 1}'
            r = {"content": [{"type": "text", "text": text}]}
            if mode == "tool-error": r["isError"] = True
            if mode == "bad-result": r = {"other": 1}
        print(json.dumps({"jsonrpc": "2.0", "method": "note"}), flush=True)
        print(json.dumps({"jsonrpc": "2.0", "id": m["id"] if mode != "wrong-id" else 99, "result": r}), flush=True)
    """
)


@pytest.fixture
def server(tmp_path):
    path = tmp_path / "server.py"
    path.write_text(SERVER)
    return lambda mode: [sys.executable, str(path), mode, str(tmp_path / mode)]


def emit(command, **options):
    tool = mcp.TerminalTool(command, startup_timeout_seconds=2.0, call_timeout_seconds=2.0, **options)
    try:
        return tool.emit("q", "t", Decision.of(DECISION))
    finally:
        tool.close()


def test_terminal_tool(server):
    record = emit(server("ok"))
    assert record.name == triage.TERMINAL_TOOL and record.inputs["action"] == "a" and record.outputs["content"][0]["text"] == "Echo: ok"
    echoed = emit(server("ok"), profile=" Everything_Echo ")
    assert echoed.outputs["structuredContent"] == {"accepted_action": "a", "accepted_disposition": "d"} and echoed.outputs["mcp_tool_name"] == "echo"
    assert mcp.probe(server("ok"), "echo", {"message": "hi"})["result"]["content"][0]["text"] == "Echo: hi"


@pytest.mark.parametrize("mode", ["slow-start", "slow-call", "dies"])
def test_transient_failures_are_tried_again(server, mode):
    assert emit(server(mode), retry_policy=retry.RetryPolicy(2)).outputs["content"]


@pytest.mark.parametrize(
    ("mode", "code", "options"),
    [
        ("slow-start", "mcp_startup_failed", {}), ("bad-protocol", "mcp_startup_failed", {"retry_policy": retry.RetryPolicy(3)}), ("wrong-id", "mcp_startup_failed", {}), ("no-tool", "mcp_tool_not_found", {}),
        ("bad-tools", "mcp_tool_discovery_failed", {}), ("tool-error", "mcp_tool_call_failed", {}), ("bad-result", "mcp_tool_result_invalid", {}), ("bad-echo", "mcp_tool_adapter_result_invalid", {"profile": "everything_echo"}),
        ("list-echo", "mcp_tool_adapter_result_invalid", {"profile": "everything_echo"}), ("shape-echo", "mcp_tool_adapter_result_invalid", {"profile": "everything_echo"}),
    ],
)
def test_failures_have_codes(server, mode, code, options):
    with pytest.raises(mcp.MCPError) as e:
        emit(server(mode), **options)
    assert e.value.code == code


def test_configuration(server):
    for make, code in ((lambda: mcp.StdioClient([]), "mcp_configuration_invalid"), (lambda: mcp.TerminalTool(["x"], profile="other"), "mcp_profile_invalid"), (lambda: mcp.TerminalTool(["x"], profile="everything_echo", tool_name="y"), "mcp_configuration_invalid"), (lambda: mcp.StdioClient(["/no/such/file"]).list_tools(), "mcp_startup_failed")):
        with pytest.raises(mcp.MCPError) as e:
            make()
        assert e.value.code == code


def test_driver_loop_gives_the_same_columns(spark):
    fake = Fake(openai("emit_triage_decision", DECISION), openai("emit_reasoning_scores", SCORES))
    runtime = providers.HostedRuntime("openai", api_key="k", transport=fake)
    rows = spark.createDataFrame([("q", "t", [("d1", 1.0, "hybrid", "text")], *TARGET.values())], f"query_id string, query_text string, evidence {triage.EVIDENCE}, expected_action string, expected_disposition string, expected_evidence_ids array<string>, rationale_keyword string")
    done = run(spark, rows, runtime, runtime, LocalTool())
    names = ["openai:gpt-5"]
    assert tuple(triage.gates(done, names=names, roles=["triager", "judge"]).first()) == (True, True)
    assert triage.mean_scores(done).first().asDict() == SCORES
