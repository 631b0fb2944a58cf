"""Times of Spark's own: what the tasks of a job took, without planning, scheduling and the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Times:
    """Sums over the tasks of all stages that ran: milliseconds run and of CPU, rows read from inputs, and stages by name."""

    run_ms: float
    cpu_ms: float
    rows_read: int
    stages: dict[str, float]


def of_tasks(spark: SparkSession, action: Callable[[], object]) -> Times:
    """Run an action, and read the times of its jobs' stages from the session's status store. Skipped stages take none."""
    context = spark.sparkContext
    group = f"quillon-{uuid.uuid4().hex}"
    before = [context.getLocalProperty(f"spark.{name}") for name in ("jobGroup.id", "job.description")]
    context.setJobGroup(group, "timed")
    try:
        action()
    finally:
        for name, value in zip(("jobGroup.id", "job.description"), before):
            context.setLocalProperty(f"spark.{name}", value)
    jvm = context._jsc.sc()
    jvm.listenerBus().waitUntilEmpty()
    store = jvm.statusStore()
    jobs = store.jobsList(None)
    own = [j for j in (jobs.apply(i) for i in range(jobs.size())) if j.jobGroup().isDefined() and j.jobGroup().get() == group]
    numbers = sorted({int(j.stageIds().apply(i)) for j in own for i in range(j.stageIds().size())})
    run = cpu = rows = 0
    stages: dict[str, float] = {}
    for number in numbers:
        stage = store.lastStageAttempt(number)
        if stage.status().toString() != "COMPLETE":
            continue
        run, cpu, rows = run + stage.executorRunTime(), cpu + stage.executorCpuTime() / 1e6, rows + stage.inputRecords()
        stages[f"{number}: {stage.name()}"] = float(stage.executorRunTime())
    return Times(float(run), float(cpu), int(rows), stages)


def kernel_ms(queries: DataFrame, docs: DataFrame, score: Callable, reads: list[str]) -> tuple[float, int]:
    """(task milliseconds that scoring takes a query, pairs scored) of a bounded number of queries against docs, in one job:
    the CPU time of the tasks that read, pair and score, less that of tasks that only read and pair. ``reads`` are the
    columns that score() needs."""
    spark = docs.sparkSession
    both = docs.crossJoin(F.broadcast(queries))
    seen = Observation("pairs")
    idle = F.hash(*reads)  # all columns are read and paired, but not scored
    scored = both.select(score().alias("score")).observe(seen, F.count(F.lit(1)).alias("n"))
    noop = lambda frame: lambda: frame.write.format("noop").mode("overwrite").save()
    noop(both.select(idle.alias("read")))()  # code is compiled and files are read once before
    without = of_tasks(spark, noop(both.select(idle.alias("read"))))
    whole = of_tasks(spark, noop(scored))
    n = int(seen.get["n"])
    return max(0.0, whole.cpu_ms - without.cpu_ms) / max(1, queries.count()), n
