"""Token ids in shards, each a wavelet matrix.

A shard is one compressed file with one row: the ids of some whole documents as one wavelet matrix, with the documents'
own ids and lengths. The matrix holds the ids as their ranks among the shard's distinct ids, and these as bit-planes, the
highest bit first, where each plane orders the ranks by the planes before it; and per plane the number of zeros and the
ones before every RANK_BITS bits. From these alone come the ids at some positions (access), the number of times an id
occurs before a position (count) and the place of its k-th occurrence (locate). Documents are read back by access.

Payload, all little-endian: u32 number of ids, u32 number of distinct ids, these as u32 in order, then per plane u32
zeros, the ones before as u32 and the bits, the first in the lowest bit of a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, ship
from quillon.llm.tokens import Encoder, encoded

#: Ids of a shard at most; a longer document is a shard of its own. A task whose partition has more writes several.
SHARD_IDS = 1 << 21
#: Ids that are read back at a time.
RUN_IDS = 1 << 15
RANK_BITS = 512
SHARD_SCHEMA = "part int, shard int, n_ids bigint, docs array<bigint>, lengths array<bigint>, payload binary"


def build(ids: np.ndarray) -> bytes:
    """The payload of a shard of ids."""
    n = len(ids)
    if ids.dtype.itemsize == 2:
        alphabet = np.flatnonzero(np.bincount(ids, minlength=1))[: n or 0].astype("<u4")
        rank = np.zeros(1 << 16, ids.dtype)
        rank[alphabet] = np.arange(len(alphabet))
        ids = rank[ids]
    else:
        alphabet, ids = np.unique(ids, return_inverse=True)
        alphabet, ids = alphabet.astype("<u4"), ids.astype("<u4")
    planes = max(len(alphabet) - 1, 0).bit_length()
    parts = [np.array([n, len(alphabet)], "<u4").tobytes(), alphabet.tobytes()]
    for bit in range(planes - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << bit)) != 0
        low = np.compress(~ones, ids)
        packed = np.packbits(ones, bitorder="little")
        counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (RANK_BITS // 8))).view("<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1)
        ranks = np.concatenate(([0], np.cumsum(counts)))[: len(counts)].astype("<u4")
        parts += [np.array([len(low)], "<u4").tobytes(), ranks.tobytes(), packed.tobytes()]
        ids = np.concatenate((low, np.compress(ones, ids)))
    return b"".join(parts)


class Matrix:
    """A shard's ids, read from its payload."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 2)
        self.n = int(head[0])
        self.alphabet = np.frombuffer(payload, "<u4", int(head[1]), 8)
        self.planes = max(len(self.alphabet) - 1, 0).bit_length()
        size, marks = (self.n + 7) // 8, -(-((self.n + 7) // 8) // (RANK_BITS // 8))
        self.zeros, self.ranks, self.bits, at = [], [], [], 8 + 4 * len(self.alphabet)
        for _ in range(self.planes):
            self.zeros.append(int(np.frombuffer(payload, "<u4", 1, at)[0]))
            self.ranks.append(np.frombuffer(payload, "<u4", marks, at + 4))
            self.bits.append(np.frombuffer(payload, np.uint8, size, at + 4 + 4 * marks))
            at += 4 + 4 * marks + size
        self._read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        mark = i // RANK_BITS
        found = int(self.ranks[plane][mark])
        first, last = mark * RANK_BITS // 8, i >> 3
        found += int(np.bitwise_count(self.bits[plane][first:last]).sum())
        return found + (int(self.bits[plane][last]) & ((1 << (i & 7)) - 1)).bit_count()

    def _select(self, plane: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a plane that equals one, by bisection of the ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def _words(self, plane: int) -> tuple[np.ndarray, np.ndarray]:
        """A plane's bits in words of 64, and the ones before each: those that the plane states for each RANK_BITS, and
        those of the words since."""
        if plane not in self._read:
            bits = self.bits[plane]
            words = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8) + 8)).view("<u8")
            own = np.bitwise_count(words[: len(words) - 1]).reshape(-1, RANK_BITS // 64).astype("<u4")
            since = np.cumsum(own, axis=1, dtype="<u4") - own
            self._read[plane] = words, np.append((self.ranks[plane][:, None] + since).ravel(), np.uint32(self.n - self.zeros[plane]))
        return self._read[plane]

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at positions, each from 0 to n - 1."""
        at, value = np.asarray(positions).astype("<u4"), np.zeros(len(positions), "<u4")
        for p in range(self.planes):
            words, before = self._words(p)
            place = at >> np.uint32(6)
            word, bit = words[place], (at & np.uint32(63)).astype(np.uint64)
            one = (word >> bit).astype("<u4") & np.uint32(1)
            ones = before[place] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            value = value << np.uint32(1) | one
            at = np.where(one, ones + np.uint32(self.zeros[p]), at - ones)
        return self.alphabet[value]

    def _rank(self, value: int) -> int:
        """An id's place in the alphabet; -1 if it has none."""
        k = int(np.searchsorted(self.alphabet, value))
        return k if k < len(self.alphabet) and self.alphabet[k] == value else -1

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for p in range(self.planes):
            if value >> (self.planes - 1 - p) & 1:
                lo, hi = self.zeros[p] + self._ones(p, lo), self.zeros[p] + self._ones(p, hi)
            else:
                lo, hi = lo - self._ones(p, lo), hi - self._ones(p, hi)
        return lo, hi

    def count(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before position end."""
        value = self._rank(value)
        if value < 0:
            return 0
        lo, hi = self._range(value, self.n if end is None else end)
        return hi - lo

    def locate(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        value = self._rank(value)
        if value < 0:
            return -1
        lo, hi = self._range(value, self.n)
        if k < 0 or lo + k >= hi:
            return -1
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - p) & 1
            i = self._select(p, one, i - self.zeros[p] if one else i)
        return i


def _shards(path: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        kind = np.dtype("<u2" if max(encoder.bits, end_id.bit_length()) <= 16 else "<u4")
        context = TaskContext.get()
        part, shard = context.partitionId() if context else 0, 0
        docs, parts, held = [], [], 0

        def out() -> pa.RecordBatch:
            row = [[part], [shard], [held], [docs], [[len(x) for x in parts]], [build(np.concatenate(parts))]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "shard", "n_ids", "docs", "lengths", "payload"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, bounds in encoded(encoder, batch.column(1)):
                for k in range(len(bounds) - 1):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], kind.type(end_id)).astype(kind, copy=False)
                    if parts and held + len(own) > shard_ids:
                        yield out()
                        shard, docs, parts, held = shard + 1, [], [], 0
                    docs.append(names[first + k])
                    parts.append(own)
                    held += len(own)
        if parts:
            yield out()

    return write


def write_shards(docs: DataFrame, folder: str, path: str, *, end_id: int, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each with end_id after it, as shard files in ascending id order.

    Rows of one id are in the order of a hash of their text; null ids come first, null texts are empty and repeated rows
    all stay. An empty table gives a folder without shards. Ids are those of the tokenizers library for the file at
    path, with add_special_tokens=False. Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")
    shards = dealt.mapInArrow(_shards(path, end_id, shard_ids), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(folder)


def read_shards(spark, folder: str) -> DataFrame:
    """The shards, as written."""
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            matrix, ends = Matrix(row["payload"]), np.cumsum(row["lengths"], dtype=np.int64)
            starts = ends - row["lengths"]
            sums, first = np.zeros(len(ends), np.int64), 0
            while first < len(ends):  # whole documents of about RUN_IDS ids, or a part of a longer one
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + RUN_IDS, "right")))
                crc = 0
                for at in range(int(starts[first]), int(ends[last - 1]), RUN_IDS):
                    ids = matrix.access(np.arange(at, min(at + RUN_IDS, int(ends[last - 1])))).astype("<u4")
                    if last == first + 1:
                        sums[first] = crc = zlib.crc32(ids, crc)
                    else:
                        sums[first:last] = [zlib.crc32(ids[i:j]) for i, j in zip((starts[first:last] - at).tolist(), (ends[first:last] - at).tolist())]
                first = last
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(starts), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "shard", "first", "n_tokens", "ids_crc32"],
            )


def documents(spark, folder: str) -> DataFrame:
    """Per document, read back from the shard files: doc_id, start, n_tokens, ids_crc32, part, shard, first.

    start counts the ids of all documents before it, over all shards in the order of (part, shard); first those before it
    in its shard. ids_crc32 is the CRC of its ids as little-endian unsigned 32-bit integers, the end id included. No
    files give no rows.
    """
    ship(spark)
    shards = read_shards(spark, folder)
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    found = shards.mapInArrow(_read_documents, "doc_id bigint, part int, shard int, first bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "first")


def find(spark, folder: str, token: int, *, most: int = 1_000) -> DataFrame:
    """(part, shard, n, positions): how often an id occurs in each shard that has it, and the first ``most`` positions
    there, by count and locate on the shard's own planes."""
    ship(spark)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, shard, payload in zip(*(c.to_pylist() for c in batch.columns)):
                matrix = Matrix(payload)
                if n := matrix.count(token):
                    rows.append((part, shard, n, [matrix.locate(token, k) for k in range(min(n, most))]))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "shard", "n", "positions"])

    return read_shards(spark, folder).select("part", "shard", "payload").mapInArrow(go, "part int, shard int, n bigint, positions array<bigint>")


def token_files(docs: DataFrame, path: str, *, end_id: int, folder: str | None = None, **columns) -> DataFrame:
    """write_shards() into a folder, a new one in the shared folder by default, and documents() read back from it.

    One row per row of docs, null ids and repeated rows included; null and empty texts have the end id alone. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or Scratch(spark, "shards").path("ids")
    write_shards(docs, folder, path, end_id=end_id, **columns)
    return documents(spark, folder)
