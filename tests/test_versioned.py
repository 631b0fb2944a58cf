import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import store
from quillon.sources.versioned import Conflict, VersionedTable

KIND = "id long, seq long, s string, v double"


def changes(seed, n, ids=400):
    r = random.Random(seed)
    return [(r.choice([None, *range(ids)]), r.randrange(1000), r.choice([None, "x", "y", f"{seed}"]), r.choice([None, float(r.randrange(9))])) for _ in range(n)]


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(k, -1, f"s{k}", None) for k in range(300)], KIND)


def merged(base, batches):
    """Plain Python: per id and column the last value by seq, among equal numbers the later batch, then the greater value."""
    out = {}
    for order, batch in enumerate([base, *batches]):
        for k, seq, *values in batch:
            own = out.setdefault(k, [seq, None, None])
            own[0] = max(own[0], seq)
            for i, x in enumerate(values):
                if x is not None and (own[i + 1] is None or (seq, order) > own[i + 1][0]):
                    own[i + 1] = ((seq, order), x)
    return sorted(repr((k, s, a and a[1], b and b[1])) for k, (s, a, b) in out.items())


def unique(rows):
    """No two changes of one id and number in a batch."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_merge_on_read_and_compaction(spark, base, tmp_path):
    table = VersionedTable.create(base, str(tmp_path / "t"), buckets=4)
    first = [tuple(r) for r in base.collect()]
    batches = [unique(changes(k, 60)) for k in (1, 2, 3)]
    for b in batches:
        table.write(spark.createDataFrame(b, KIND))
    want = merged(first, batches)
    assert table.version() == 4 and rows(table.read()) == want
    pinned = table.read()
    assert table.compact() == 5 and len(table.manifest()["parts"]) == 1 and rows(table.read()) == want == rows(pinned)
    late = unique(changes(9, 80))
    table.write(spark.createDataFrame(late, KIND))  # with numbers below those of the base
    assert rows(table.read()) == merged(first, [*batches, late])
    assert rows(table.read(1)) == sorted(map(repr, first)) and rows(table.read(3)) == merged(first, batches[:2])
    again = VersionedTable.open(spark, str(tmp_path / "t"))
    assert rows(again.read()) == rows(table.read()) and again.schema.names == ["id", "seq", "s", "v"]


def test_equal_to_upsert_in_any_order(spark, base, tmp_path):
    every = list({r[1]: r for r in changes(5, 300)}.values())  # one change a number
    want = rows(store.upsert(base, spark.createDataFrame(every, KIND)))
    for k, order in enumerate((every, every[::-1])):
        table = VersionedTable.create(base, str(tmp_path / f"t{k}"), buckets=3)
        for i in range(0, len(order), 120):
            table.write(spark.createDataFrame(order[i : i + 120], KIND))
            if i == 120:
                table.compact()
        assert rows(table.read()) == want


def test_a_small_change_writes_little(spark, tmp_path):
    big = spark.range(600_000).select("id", F.lit(0).cast("long").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("s"), F.rand(1).alias("v"))
    table = VersionedTable.create(big, str(tmp_path / "t"), buckets=4)
    table.write(big.where("id % 100 = 7").withColumn("seq", F.lit(1).cast("long")))
    sizes = list(table.part_bytes().values())
    assert sizes[1] < 0.03 * sizes[0]
    assert table.read().count() == 600_000 and table.read().where("seq = 1").count() == 6000


def metrics(frame):
    """(files, rows) that the scans of an executed plan read."""
    frame.collect()
    found = [0, 0]
    plan = frame._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        elif name.startswith("Scan"):
            found[0] += node.metrics().apply("numFiles").value()
            found[1] += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return found


def test_fetch_reads_few_files_and_row_groups(spark, tmp_path, monkeypatch):
    from quillon.sources import versioned

    monkeypatch.setattr(versioned, "ROW_GROUP", 64 << 10)
    big = spark.range(400_000).select(F.col("id") * 3, F.lit(0).cast("long"), F.sha2(F.col("id").cast("string"), 256), F.rand(2)).toDF("id", "seq", "s", "v")
    table = VersionedTable.create(big, str(tmp_path / "t"), buckets=32)
    ids = [3 * k for k in range(0, 40_000, 400)] + [1, 2]
    got = table.fetch(ids)
    assert sorted(r.id for r in got.collect()) == ids[:100]
    one = table.fetch([300, 301])
    assert [r.id for r in one.collect()] == [300]
    files_read, rows_read = metrics(table.fetch([300]))
    assert files_read <= 4 and rows_read < 0.02 * 400_000
    assert metrics(table.fetch(ids))[1] < 0.5 * 400_000
    by_table = table.fetch(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert rows(by_table) == rows(got) and table.fetch([]).collect() == []


def test_failed_and_competing_writes(spark, base, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable.create(base, path, buckets=2)
    before = rows(table.read())
    bad = spark.createDataFrame([(1, 5, "new", 1.0)], KIND).withColumn("s", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.write(bad)
    assert table.version() == 1 and rows(table.read()) == before
    orphan = table._add(spark.createDataFrame([(1, 5, "lost", 1.0)], KIND), 2, "-")  # a writer that died before its manifest
    assert rows(table.read()) == before
    other = VersionedTable.open(spark, path)
    assert table._commit(2, table.manifest(1)["parts"]) and not other._commit(2, [])
    assert other.write(spark.createDataFrame([(1, 5, "new", None)], KIND)) == 3
    assert table.read().where("id = 1").first().s == "new" and rows(table.read(1)) == before
    assert table.vacuum() >= 1 and table.versions() == [3] and orphan not in table.manifest()["parts"]
    with pytest.raises(ValueError, match="there is a table"):
        VersionedTable.create(base, path)
    with pytest.raises(ValueError, match="there is no table"):
        VersionedTable.open(spark, str(tmp_path / "none"))


def test_compaction_keeps_what_others_write(spark, base, tmp_path, monkeypatch):
    table = VersionedTable.create(base, str(tmp_path / "t"), buckets=2)
    table.write(spark.createDataFrame([(1, 5, "a", None)], KIND))
    other = VersionedTable.open(spark, table.path)
    add = table._add

    def slow(*args, **options):
        other.write(spark.createDataFrame([(2, 6, "b", None)], KIND))
        return add(*args, **options)

    monkeypatch.setattr(table, "_add", slow)
    assert table.compact() == 4 and len(table.manifest()["parts"]) == 2
    assert {r.id: r.s for r in table.read().where("id < 3").collect()} == {0: "s0", 1: "a", 2: "b"}

    def twice(*args, **options):
        other.compact()
        return add(*args, **options)

    monkeypatch.setattr(table, "_add", twice)
    with pytest.raises(Conflict):
        table.compact()


def test_empty_tables(spark, base, tmp_path):
    table = VersionedTable.create(base.limit(0), str(tmp_path / "t"))
    assert table.read().collect() == []
    table.write(base.limit(0))
    table.write(base)
    assert table.read().count() == 300 and table.fetch([5]).count() == 1
    table.compact()
    assert table.read().count() == 300
