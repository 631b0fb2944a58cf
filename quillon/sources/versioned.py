"""A table with upserts that write changes only, versions that readers pin, and fetches by id that read little.

A version is a manifest, a small JSON file that names the parts of the table: one base and deltas after it. A part is a
folder of Parquet files, dealt to buckets by a hash of the id and in order of it, with bloom filters of the ids. A write
adds a part and then a manifest, which appears by a rename that never replaces another one: whoever fails before leaves
files that nothing names, and of two writers at once one sees the other's version and goes after it. Old versions stay
readable until vacuum().

Values carry the sequence number at which they were set, column by column, so the table is the same whatever batches the
changes came in, in whatever order, and before as after a compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources import files

BUCKETS = 16
#: Bytes of a row group; fetches skip row groups by the range and the bloom filter of their ids.
ROW_GROUP = 8 << 20
#: Ids of a fetch that are written into the scan's filter; a table of ids is joined.
PUSHED = 10_000
#: Times that a writer goes after others who were faster.
RETRIES = 20


class Conflict(RuntimeError):
    """Others were faster, again and again, or have compacted the parts that a compaction began with."""


@dataclass
class VersionedTable:
    """A table at a path; id_col names the key, seq_col the order of writes. Other columns are values: of each, the last one
    that is not null by seq counts, and among equal numbers the one that was written later."""

    spark: SparkSession
    path: str
    id_col: str
    seq_col: str
    buckets: int
    schema: T.StructType

    # Making and opening

    @classmethod
    def create(cls, frame: DataFrame, path: str, *, id_col: str = "id", seq_col: str = "seq", buckets: int = BUCKETS) -> VersionedTable:
        """A new table of the frame's rows, version 1. Rows of one id are merged."""
        table = cls(frame.sparkSession, path, id_col, seq_col, buckets, frame.schema)
        if table.version():
            raise ValueError(f"there is a table at {path}")
        part = table._add(frame, 1, "-")
        table._commit(1, [part])
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VersionedTable:
        probe = cls(spark, path, "", "", 0, T.StructType())
        version = probe.version()
        if not version:
            raise ValueError(f"there is no table at {path}")
        known = probe.manifest(version)
        return cls(spark, path, known["id_col"], known["seq_col"], known["buckets"], T.StructType.fromJson(known["schema"]))

    # Manifests

    def _at(self, *names: str) -> str:
        return reduce(files.join, names, self.path)

    def versions(self) -> list[int]:
        """All versions that can be read, in order."""
        at, store = files.hadoop(self.spark, self._at("manifests"))
        if not store.exists(at):
            return []
        names = [x.getPath().getName() for x in store.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The last version; 0 where there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(self._at("manifests", f"{version:020d}.json"), wholetext=True).first()[0])

    def _commit(self, version: int, parts: list[str]) -> bool:
        """Publish a version; False if there is one of this number."""
        text = json.dumps({"version": version, "id_col": self.id_col, "seq_col": self.seq_col, "buckets": self.buckets, "schema": self.schema.jsonValue(), "parts": parts})
        at, store = files.hadoop(self.spark, self._at("manifests", f".{uuid.uuid4().hex}.tmp"))
        out = store.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        to, _ = files.hadoop(self.spark, self._at("manifests", f"{version:020d}.json"))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        if store.exists(to):
            store.delete(at, False)
            return False
        try:
            context.rename(at, to, options)
        except Exception as e:  # another writer was faster
            if "FileAlreadyExists" not in str(e):
                raise
            store.delete(at, False)
            return False
        return True

    # Parts

    @property
    def values(self) -> list[str]:
        return [c for c in self.schema.names if c not in (self.id_col, self.seq_col)]

    def _bucket(self, name: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(name or self.id_col)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> T.StructType:
        """A part's columns: id, seq, and each value with the number at which it was set."""
        fields = [self.schema[self.id_col], self.schema[self.seq_col]]
        for k, c in enumerate(self.values):
            fields += [self.schema[c], T.StructField(f"_at_{k}", self.schema[self.seq_col].dataType)]
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def _numbered(self, frame: DataFrame) -> DataFrame:
        """Rows as given, with the numbers of their values."""
        columns = [F.col(self.id_col), F.col(self.seq_col)]
        for k, c in enumerate(self.values):
            columns += [F.col(c), F.when(F.col(c).isNotNull(), F.col(self.seq_col)).alias(f"_at_{k}")]
        return frame.select(*columns)

    def _merged(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """One row an id; order names a column that parts equal numbers."""
        values = []
        for k, c in enumerate(self.values):
            key = F.when(F.col(f"_at_{k}").isNotNull(), F.struct(f"_at_{k}", *([order] if order else [])))
            values += [F.max_by(c, key).alias(c), F.max(f"_at_{k}").alias(f"_at_{k}")]
        return rows.groupBy(self.id_col).agg(F.max(self.seq_col).alias(self.seq_col), *values)

    def _add(self, changes: DataFrame, number: int, mark: str, merge: bool = True) -> str:
        """Write a part; its name."""
        name = f"{number:020d}{mark}{uuid.uuid4().hex[:12]}"
        rows = self._merged(self._numbered(changes)) if merge else changes
        rows = rows.select(*self._stored().names).withColumn("_bucket", self._bucket())
        dealt = rows.repartitionByRange("_bucket", self.id_col).sortWithinPartitions("_bucket", self.id_col)
        writer = dealt.write.partitionBy("_bucket").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
        writer = writer.option(f"parquet.bloom.filter.enabled#{self.id_col}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(self._at("data", f"_part={name}"))
        return name

    def _scan(self, parts: Sequence[str]) -> DataFrame:
        paths = [self._at("data", f"_part={p}") for p in parts]
        at, store = files.hadoop(self.spark, self._at("data"))
        kind = T.StructType([*self._stored().fields, T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        some = [p for p in paths if any(x.isDirectory() for x in store.listStatus(files.hadoop(self.spark, p)[0]))]
        if not some:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", self._at("data")).parquet(*some)

    def _together(self, base: DataFrame, deltas: DataFrame) -> DataFrame:
        """Rows of a base with their changes, and those that only the deltas have. The base is not shuffled where the deltas'
        ids are few enough for Spark to broadcast."""
        new = self._merged(deltas, "_part").withColumn("_bucket", self._bucket())
        late = new.select(*(F.col(c).alias(f"_new_{c}") for c in new.columns))
        same = (F.col("_bucket") == F.col("_new__bucket")) & F.col(self.id_col).eqNullSafe(F.col(f"_new_{self.id_col}"))
        columns = [F.col(self.id_col), F.greatest(self.seq_col, f"_new_{self.seq_col}").alias(self.seq_col)]
        for k, c in enumerate(self.values):
            at, then = F.col(f"_at_{k}"), F.col(f"_new__at_{k}")
            wins = then.isNotNull() & (at.isNull() | (then >= at))
            columns += [F.when(wins, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c), F.greatest(at, then).alias(f"_at_{k}")]
        old = base.join(late, same, "left").select(*columns)
        ids = base.select(F.col(self.id_col).alias("_id"), F.col("_bucket").alias("_b"))
        alone = new.join(ids, (F.col("_bucket") == F.col("_b")) & F.col(self.id_col).eqNullSafe(F.col("_id")), "left_anti")
        return old.unionByName(alone.select(*old.columns))

    def _rows(self, parts: Sequence[str], only: Column | None = None) -> DataFrame:
        base, deltas = self._scan(parts[:1]), self._scan(parts[1:])
        if only is not None:
            base, deltas = base.where(only), deltas.where(only)
        return (self._together(base, deltas) if len(parts) > 1 else base).select(*self._stored().names)

    # Reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, by default the last one now; later writes do not show in it."""
        return self._rows(self.manifest(version)["parts"]).select(*self.schema.names)

    def write(self, changes: DataFrame) -> int:
        """Add the changes, a table with the same columns; the new version. What is written has a row for each id in changes."""
        number = self.version() + 1
        part = self._add(changes.select(*self.schema.names), number, "-")
        for _ in range(RETRIES):
            last = self.version()
            if self._commit(last + 1, [*self.manifest(last)["parts"], part]):
                return last + 1
        raise Conflict("the table changes too often")

    def compact(self) -> int:
        """Make one base of all parts; the new version. Deltas that others write meanwhile stay deltas."""
        last = self.version()
        parts = self.manifest(last)["parts"]
        if len(parts) == 1:
            return last
        newest = max(int(p[:20]) for p in parts)
        base = self._add(self._rows(parts), newest, "~", merge=False)
        for _ in range(RETRIES):
            last = self.version()
            now = self.manifest(last)["parts"]
            if now[: len(parts)] != parts:
                raise Conflict("another compaction was faster")
            if self._commit(last + 1, [base, *now[len(parts) :]]):
                return last + 1
        raise Conflict("the table changes too often")

    def fetch(self, ids: DataFrame | Sequence, version: int | None = None) -> DataFrame:
        """The rows with one of the ids, each once. Ids of a sequence go into the scan, which reads their buckets only, and of
        these the row groups whose range and bloom filter admit one; a table of ids (a column like id_col) is joined."""
        parts = self.manifest(version)["parts"]
        if isinstance(ids, DataFrame):
            wanted = ids.select(self.id_col).distinct()
            return self._rows(parts).join(wanted, self.id_col, "left_semi").select(*self.schema.names)
        ids = list(dict.fromkeys(ids))
        if len(ids) > PUSHED:
            return self.fetch(self._ids(ids), version)
        if not ids:
            return self.read(version).limit(0)
        buckets = [r[0] for r in self._ids(ids).select(self._bucket()).distinct().collect()]  # at most as many as there are
        only = F.col("_bucket").isin(buckets) & F.col(self.id_col).isin(ids)
        return self._rows(parts, only).select(*self.schema.names)

    def _ids(self, ids: Sequence) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(self.id_col, self.schema[self.id_col].dataType)]))

    def part_bytes(self, version: int | None = None) -> dict[str, int]:
        """Bytes of each part of a version."""
        out = {}
        for p in self.manifest(version)["parts"]:
            at, store = files.hadoop(self.spark, self._at("data", f"_part={p}"))
            out[p] = store.getContentSummary(at).getLength()
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the parts that none of them names; how many parts went. Not to be run
        while others write, whose parts are not named yet."""
        versions = self.versions()
        kept = {p for v in versions[-keep:] for p in self.manifest(v)["parts"]}
        for v in versions[:-keep]:
            at, store = files.hadoop(self.spark, self._at("manifests", f"{v:020d}.json"))
            store.delete(at, False)
        at, store = files.hadoop(self.spark, self._at("data"))
        gone = [x.getPath() for x in store.listStatus(at) if x.getPath().getName().removeprefix("_part=") not in kept]
        for path in gone:
            store.delete(path, True)
        return len(gone)
