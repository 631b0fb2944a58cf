"""Tables of multivectors: Parquet on disk with a manifest, and an upsert store."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources import files

MULTIVECTORS = T.StructType([T.StructField("alert_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mv_fp16", T.ArrayType(T.ArrayType(T.FloatType())))])
BINARY = T.StructType([T.StructField("_rowid", T.StringType()), T.StructField("mv_bin", T.ArrayType(T.LongType()))])


def multivectors(spark: SparkSession, ids: Sequence[str], vectors: Sequence[Sequence[Sequence[float]]], texts: Sequence[str] | None) -> DataFrame:
    """A table of MULTIVECTORS from driver data; texts are required and all lengths equal."""
    if texts is None:
        raise ValueError("texts are required")
    if not len(ids) == len(vectors) == len(texts):
        raise ValueError("ids, documents and texts must have equal lengths")
    rows = []
    for i, v, t in zip(ids, vectors, texts):
        if any(not hasattr(row, "__len__") for row in v) or len({len(row) for row in v}) > 1:
            raise ValueError("documents must be two-dimensional")
        rows.append((str(i), t, [[float(x) for x in row] for row in v]))
    return spark.createDataFrame(rows, MULTIVECTORS)


def write_multivectors(frame: DataFrame, path: str) -> None:
    """Write a table of MULTIVECTORS and its manifest (a text file of JSON beside the data)."""
    frame.select(*(F.col(f.name).cast(f.dataType) for f in MULTIVECTORS)).write.mode("overwrite").parquet(f"{path}/data")
    spark = frame.sparkSession
    manifest = {"backend": "spark", "format": "parquet", "row_count": size(read_multivectors(spark, path)), "note": "one row a document"}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_multivectors(spark: SparkSession, path: str) -> DataFrame:
    """The table as a scan; columns and filters that a query does not need are not read."""
    return spark.read.schema(MULTIVECTORS).parquet(f"{path}/data")


def fetch(frame: DataFrame, ids: DataFrame | Sequence[str], id_col: str = "alert_id") -> DataFrame:
    """The rows with one of the ids, each once; ids that are not there are skipped. Ids of a sequence are in its order,
    by where each stands first."""
    if isinstance(ids, DataFrame):
        return frame.join(ids.select(id_col).distinct(), id_col, "left_semi")
    if not ids:
        return frame.limit(0)
    asked = frame.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], T.StructType([T.StructField(id_col, frame.schema[id_col].dataType), T.StructField("_asked", T.LongType())]))
    return frame.join(F.broadcast(asked), id_col).orderBy("_asked").select(*frame.columns)  # as many rows as the caller gave


def size(frame: DataFrame, column: str | None = None) -> int:
    """Rows; with a column, those that have it."""
    return frame.count() if column is None else frame.where(F.col(column).isNotNull()).count()


def upsert(table: DataFrame, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The table after changes, per id and column the last value that is not null by seq; earlier ones stay.

    Both have the same columns; seq orders the writes, and a change comes after rows of equal seq in the table.
    """
    both = table.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)))
    order = F.struct(seq_col, "_late")
    others = [c for c in table.columns if c not in (id_col, seq_col)]
    return both.groupBy(id_col).agg(F.max(seq_col).alias(seq_col), *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in others)).select(*table.columns)


def in_id_order(frame: DataFrame, id_col: str = "id") -> DataFrame:
    return frame.orderBy(F.col(id_col).cast("string"))


def row_ids(frame: DataFrame, order_col: str) -> DataFrame:
    """Add _rowid, the position by order_col as text. The rows are written in ranges of order_col, and numbered by the
    rows before each range and their place in it."""
    place = F.monotonically_increasing_id()
    ranged = files.stored(frame.repartitionByRange(order_col).sortWithinPartitions(order_col).withColumn("_at", place), "row-ids")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(before, "_part").select(*frame.columns, (F.col("_before") + inside).cast("string").alias("_rowid"))
