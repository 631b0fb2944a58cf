"""What the operators share about the cluster: code shipping, shared tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "spark.quillon.shipped"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions passed to them can import it there."""
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="quillon-code-")) / "quillon_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context.setLocalProperty(_SHIPPED, "yes")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session, whose executors are threads of
    the driver, gets one of its own where that is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_broadcasts: list[Broadcast] = []
_scratches: list[Scratch] = []


def broadcast(spark: SparkSession, value) -> Broadcast:
    """A broadcast that written() takes back."""
    _broadcasts.append(spark.sparkContext.broadcast(value))
    return _broadcasts[-1]


@contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """What operators broadcast and write for themselves within is deleted at the end, when their results must be written
    elsewhere. Then the driver collects its garbage: Spark's cleaner frees the shuffles and broadcasts of finished plans
    only after that."""
    broadcasts, scratches = len(_broadcasts), len(_scratches)
    yield
    while len(_broadcasts) > broadcasts:
        _broadcasts.pop().destroy()
    while len(_scratches) > scratches:
        _scratches.pop().delete()
    spark._jvm.System.gc()


class Scratch:
    """Tables written in the shared folder. They cut the lineage, and outlive any executor. What is not dropped before
    is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
        self.made = 0
        root, files = self._at(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)
        _scratches.append(self)

    def _at(self, path: str):
        """(path, its file system) of Hadoop."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, tag: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{tag}"

    def table(self, frame: DataFrame, tag: str) -> DataFrame:
        """Write the frame and read it back."""
        path = self.path(tag)
        frame.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._quillon_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made here, once nothing will read them again."""
        for frame in frames:
            path, files = self._at(frame._quillon_path)
            files.delete(path, True)

    def delete(self) -> None:
        """Delete all tables made here."""
        path, files = self._at(self.root)
        files.delete(path, True)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b) but the roots; root is the smallest node of the component.

    Alternating large-star and small-star steps. Each step is a minimum per node, which is aggregated before the
    shuffle, and a join, which adaptive execution splits where a node is hot. No edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.table(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = scratch.table(small.select("e.*").where("a <> b").distinct(), "small")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        scratch.drop(large)
        e = after
        if new == mark:
            break
        mark = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
