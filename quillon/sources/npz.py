"""Arrays in .npz archives as a data source: each task reads a range of rows, a block at a time.

The driver reads the archive's directory and the headers of two arrays: ids and rows of equal number. Each partition opens
the archive anew, goes to its first row and reads so many rows at a time, so neither an archive nor an array is ever held
whole, whatever their sizes. Stored arrays are sought in; of compressed ones what is before the range is decompressed and
dropped. Archives must be at paths that all machines see; others are read by sources.fixtures through Spark.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.sources import files

#: Bytes of an array in a partition, and in a block that is read at once.
PARTITION, BLOCK = 128 << 20, 4 << 20


def local(path: str) -> str | None:
    """The path in the file system of a plain path or a file: URI, None for other URIs."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        return None
    return unquote(found.path) if found.scheme else path


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Member:
    """An array of an archive: its shape and type, and its rows from any one on."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        import numpy as np

        self.archive, self.file = archive, f"{name}.npy"
        with archive.open(self.file) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, fortran, self.kind = read(f)
            self.begin = f.tell()
        if self.kind.hasobject:
            raise ValueError(f"{name}: arrays of objects are not read")
        if fortran and len(self.shape) > 1:
            raise ValueError(f"{name}: arrays in Fortran order are not read by rows")
        if not self.shape:
            raise ValueError(f"{name}: a single value has no rows")
        self.row = self.kind.itemsize * math.prod(self.shape[1:])

    def blocks(self, first: int, last: int, rows: int) -> Iterator[Any]:
        import numpy as np

        with self.archive.open(self.file) as f:
            f.seek(self.begin + first * self.row)
            for k in range(first, last, rows):
                n = min(rows, last - k)
                data = f.read(n * self.row)
                if len(data) < n * self.row:
                    raise ValueError(f"{self.file}: the archive ends within its rows")
                yield np.frombuffer(data, self.kind).reshape(n, *self.shape[1:])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.ids, self.rows = given["path"], given["ids"], given["rows"]
        self.bytes = int(given.get("partitionbytes", PARTITION))

    def partitions(self) -> list[_Range]:
        with zipfile.ZipFile(self.path) as archive:
            ids, rows = _Member(archive, self.ids), _Member(archive, self.rows)
        if ids.shape[0] != rows.shape[0]:
            raise ValueError(f"{self.path}: {ids.shape[0]} ids and {rows.shape[0]} rows")
        if len(rows.shape) != 3:
            raise ValueError(f"{self.path}: {self.rows} must have three dimensions")
        n = rows.shape[0]
        step = max(1, self.bytes // max(1, rows.row))
        return [_Range(k, min(k + step, n)) for k in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import numpy as np

        with zipfile.ZipFile(self.path) as archive:
            ids, rows = _Member(archive, self.ids), _Member(archive, self.rows)
            many = max(1, BLOCK // max(1, rows.row))
            for names, tokens in zip(ids.blocks(partition.first, partition.last, many), rows.blocks(partition.first, partition.last, many)):
                for name, own in zip(names.tolist(), tokens.astype(np.float32).tolist()):
                    yield str(name), own


class NpzSource(DataSource):
    """Format ``quillon_npz``: (id string, fp16 array<array<float>>) of the arrays named by the options ids and rows in the
    archive at the option path; partitionBytes bounds the bytes of rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "quillon_npz"

    def schema(self) -> str:
        return "id string, fp16 array<array<float>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def matrices(spark: SparkSession, path: str, kind: str, *, partition_bytes: int = PARTITION) -> DataFrame:
    """(id, fp16) of the arrays {kind}_ids and {kind}_tokens of one archive."""
    files.ship(spark)
    spark.dataSource.register(NpzSource)
    found = local(path)
    if found is None:
        raise ValueError(f"{path} is not on a path that all machines see")
    return spark.read.format("quillon_npz").option("path", found).option("ids", f"{kind}_ids").option("rows", f"{kind}_tokens").option("partitionBytes", partition_bytes).load()
