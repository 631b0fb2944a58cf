import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillon.functions.kernels import hamming_maxsim
from quillon.operators import topk
from quillon.streaming import standing

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCORE = lambda: hamming_maxsim("q_bin", "bin").cast("double")


def documents(n=240):
    r = random.Random(4)
    return [(f"d{i:03d}", [r.getrandbits(6)] if i % 40 else None, START + timedelta(seconds=i)) for i in range(n)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", [3]), ("q2", [40, 7]), ("q3", [])], "query_id string, q_bin array<bigint>")


def streamed(spark, tmp_path, batches, queries, **options):
    """The last result after the batches, each a file of its own."""
    kind = "doc_id string, bin array<bigint>, ts timestamp"
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder / f"part={k:03d}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", standing.STORE)
    try:
        docs = spark.readStream.schema(kind + ", part int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("part")
        found = standing.standing(docs, queries, SCORE, 5, **options)
        write = lambda frame, batch: frame.withColumn("batch_id", F.lit(batch)).write.mode("append").parquet(str(tmp_path / "out"))
        run = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert run.awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in standing.latest(spark.read.parquet(str(tmp_path / "out"))).collect())


def batch(spark, rows, queries):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, bin array<bigint>")
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in topk.against_all(queries, docs, SCORE, 5).collect())


@pytest.mark.parametrize("order", [1, 2])
def test_any_order_of_batches_equals_the_batch_lane(spark, tmp_path, queries, order):
    rows = documents()
    mixed = random.Random(order).sample(rows, len(rows))
    got = streamed(spark, tmp_path, [mixed[i : i + 60] for i in range(0, len(mixed), 60)], queries)
    assert got == batch(spark, rows, queries)


def test_expired_documents_make_room(spark, tmp_path, queries):
    rows = documents()
    mixed = random.Random(9).sample(rows, len(rows))
    got = streamed(spark, tmp_path, [mixed[i : i + 80] for i in range(0, len(mixed), 80)], queries, time_col="ts", keep_seconds=50)
    last = max(r[2] for r in rows)
    assert got == batch(spark, [r for r in rows if r[2] > last - timedelta(seconds=50)], queries)


def test_a_query_with_nothing_left(spark, tmp_path, queries):
    rows = [("a", [3], START), ("b", None, START + timedelta(hours=1))]
    assert streamed(spark, tmp_path, [rows[:1], rows[1:]], queries, time_col="ts", keep_seconds=50) == []


def test_what_is_needed_by_brute_force():
    r = random.Random(1)
    for _ in range(200):
        rows = [(f"d{i}", float(r.randrange(4)), float(r.randrange(6))) for i in range(r.randrange(12))]
        kept = standing.still_needed(rows, 2, 3.0)
        for now in range(-3, 8):  # whatever expires, the two best of those kept are the two best of all
            alive = lambda some: sorted((x for x in some if x[2] > now), key=lambda x: (-x[1], x[0]))[:2]  # noqa: B023, E731
            assert alive(kept) == alive(rows)
        parts = standing.still_needed([*standing.still_needed(rows[:5], 2, 3.0), *standing.still_needed(rows[5:], 2, 3.0)], 2, 3.0)
        assert parts == kept
    assert standing.still_needed([("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", 2.0, 0.0)], 2, None) == [("c", 2.0, 0.0), ("a", 1.0, 0.0)]


def test_arguments(spark, queries):
    docs = spark.createDataFrame([], "doc_id string, bin array<bigint>, ts timestamp")
    for options in ({"k": 0}, {"k": 1, "time_col": "ts"}, {"k": 1, "keep_seconds": 3.0}):
        with pytest.raises(ValueError):
            standing.standing(docs, queries, SCORE, **options)
