"""Files and tables in stores that Spark reaches: any URI of a Hadoop file system, and plain local paths."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def is_uri(path: str | Path) -> bool:
    return "://" in str(path)


def join(folder: str | Path, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}"


def hadoop(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at a path, which change when a table is written anew."""
    at, store = hadoop(spark, path)
    found = store.listStatus(at)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def write_text(path: str | Path, text: str) -> None:
    """Replace a file."""
    if is_uri(path):
        at, store = hadoop(SparkSession.builder.getOrCreate(), str(path))
        out = store.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def read_text(path: str | Path) -> str:
    if is_uri(path):
        return SparkSession.builder.getOrCreate().read.text(str(path), wholetext=True).first()[0]
    return Path(path).read_text()


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


_SHIPPED = "spark.quillon.files.shipped"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions passed to them can import it there."""
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="quillon-code-")) / "quillon_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context.setLocalProperty(_SHIPPED, "yes")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    at, store = hadoop(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def stored(frame: DataFrame, tag: str) -> DataFrame:
    """The frame, computed once and written in the shared folder."""
    path = join(new_folder(frame.sparkSession, tag), "data")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
