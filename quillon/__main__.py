"""Evaluation runs from the command line: python -m quillon RUN --help."""

from __future__ import annotations

import argparse
import json
import shlex
import subprocess
import sys

from quillon.operators import triage
from quillon.plans import harness
from quillon.runtime import mcp, providers, retry
from quillon.sources import files, reports


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description=__doc__)
    runs = top.add_subparsers(dest="run", required=True)

    def add(name: str, said: str, *, fixtures: bool = True) -> argparse.ArgumentParser:
        own = runs.add_parser(name, help=said)
        if fixtures:
            own.add_argument("--fixture-dir", type=str, required=True)
        own.add_argument("--out-json", type=str)
        own.add_argument("--master", default="local[*]", help="Spark master where no session is set up by spark-submit")
        return own

    exact = add("exact", "the exact cosine lane")
    exact.add_argument("--out-latency", type=str)
    for name, said in (("paired", "exact against binary latency"), ("lanes", "quality and latency of five lanes")):
        own = add(name, said)
        own.add_argument("--cache-state", choices=("cold", "warm"), default="warm")
        own.add_argument("--threads", type=int, default=1)
        own.add_argument("--rerank-depth", type=int, default=5)
        if name == "lanes":
            own.add_argument("--out-latency", type=str)
    own = add("reasoning", "retrieve, decide, judge and emit")
    own.add_argument("--out-trace", type=str)
    own.add_argument("--threads", type=int, default=1)
    own.add_argument("--rerank-depth", type=int, default=2)
    own.add_argument("--runtime", choices=("local", "replay", *providers.PROVIDERS), default="local")
    own.add_argument("--runtime-fixture", type=str)
    own.add_argument("--llm-model")
    own.add_argument("--judge-model")
    own.add_argument("--api-key-env")
    own.add_argument("--api-base-url")
    own.add_argument("--timeout-seconds", type=float, default=30.0)
    own.add_argument("--terminal-runtime", choices=("local", "mcp"), default="local")
    own.add_argument("--mcp-profile", default=mcp.DIRECT)
    own.add_argument("--mcp-tool-name", default=triage.TERMINAL_TOOL)
    _server(own, required=False)
    for field, kind in (("max-attempts", int), ("initial-backoff-seconds", float), ("max-backoff-seconds", float), ("backoff-multiplier", float)):
        own.add_argument(f"--retry-{field}", type=kind, default=getattr(retry.RetryPolicy(), field.replace("-", "_")))
    own = add("disposition", "analyst labels against a reasoning report")
    own.add_argument("--tier2-json", type=str, required=True)
    own = add("probe", "list a tool server's tools and call one", fixtures=False)
    own.add_argument("--tool", default=mcp.ECHO_TOOL)
    own.add_argument("--message", default="hello")
    _server(own, required=True)
    return top


def _server(own: argparse.ArgumentParser, *, required: bool) -> None:
    own.add_argument("--mcp-server-command", required=required)
    own.add_argument("--mcp-server-arg", action="append", default=[])
    own.add_argument("--mcp-startup-timeout-seconds", type=float, default=5.0)
    own.add_argument("--mcp-call-timeout-seconds", type=float, default=10.0)


def _commit() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return ""


def _runtimes(args: argparse.Namespace) -> dict:
    policy = retry.RetryPolicy(args.retry_max_attempts, args.retry_initial_backoff_seconds, args.retry_max_backoff_seconds, args.retry_backoff_multiplier)
    out: dict = {"runtime": args.runtime, "runtime_fixture": args.runtime_fixture}
    if args.runtime in providers.PROVIDERS:
        make = lambda model: providers.HostedRuntime(args.runtime, model_id=model, api_key_env=args.api_key_env, api_base_url=args.api_base_url, timeout_seconds=args.timeout_seconds, retry_policy=policy)
        out |= {"triager": make(args.llm_model), "judge": make(args.judge_model)}
    if args.terminal_runtime == "mcp":
        if not args.mcp_server_command:
            raise ValueError("mcp terminal runtime requires a server command")
        command = [*shlex.split(args.mcp_server_command), *args.mcp_server_arg]
        out["tool"] = mcp.TerminalTool(command, tool_name=args.mcp_tool_name, profile=args.mcp_profile, startup_timeout_seconds=args.mcp_startup_timeout_seconds, call_timeout_seconds=args.mcp_call_timeout_seconds, retry_policy=policy)
    return out


def main(argv: list[str] | None = None) -> dict:
    args = _parser().parse_args(argv)
    if args.run == "probe":
        out = mcp.probe([*shlex.split(args.mcp_server_command), *args.mcp_server_arg], args.tool, {"message": args.message}, startup_timeout_seconds=args.mcp_startup_timeout_seconds, call_timeout_seconds=args.mcp_call_timeout_seconds)
        if args.out_json:
            reports.write_report(out, args.out_json)
        return out
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(args.master).appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.run == "disposition":
        return harness.disposition_run(spark, files.join(args.fixture_dir, "analyst_labels.json"), args.tier2_json, out_json=args.out_json)
    given = harness.Fixtures(spark, args.fixture_dir)
    if args.run == "exact":
        return harness.exact_run(given, out_json=args.out_json, out_latency=args.out_latency)
    common = {"threads": args.threads, "rerank_depth": args.rerank_depth, "out_json": args.out_json}
    if args.run == "paired":
        return harness.paired_run(given, cache_state=args.cache_state, command=shlex.join(argv or sys.argv), commit=_commit(), **common)
    if args.run == "lanes":
        return harness.retrieval_run(given, cache_state=args.cache_state, out_latency=args.out_latency, **common)
    return harness.reasoning_run(given, out_trace=args.out_trace, **_runtimes(args), **common)


if __name__ == "__main__":
    print(json.dumps(main(), indent=2, sort_keys=True))
