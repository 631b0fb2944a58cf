"""Exact duplicates by content-defined chunk recipes.

A text loses its white space and is cut where a rolling hash of the last WINDOW bytes says so, so equal passages give
equal chunks wherever they stand. A chunk's identifier is its BLAKE2b digest, and verified: the contents of all chunks
whose digest occurs in more than one place are gathered by digest, each content once a task, and compared. Where two
contents share a digest, all is done again with longer digests under another key. So identifiers are equal exactly
where chunks are. A text is then its recipe, the ordered list of identifiers, and texts are equal when these lists are.

Recipes are shuffled, and of the contents only what stands in several places, once; texts stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, broadcast, ship
from quillon.llm._text import _SPACE, mix, runs, utf8

#: Bytes that decide on a cut. A power of two.
WINDOW = 32
LEAST, MOST = 512, 16384
#: A place is a cut with a chance of 2**-CUT_BITS.
CUT_BITS = 11
#: Bytes of an identifier.
IDENTIFIER = 16
#: Bits of the broadcast filter of digests in several places, at least and at most (as powers of two: 8 to 64 MB), and bits
#: for each of them. Where the filter has others too, as all filters do and full ones more often, more contents are compared.
LEAST_BITS, MOST_BITS, BITS_EACH = 26, 29, 16
#: Bytes of contents that a task remembers as given already.
REMEMBERED = 32 << 20

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """The ends of the chunks of each row of data; of empty rows, none."""
    rolling = _GEAR[data]
    k = 1
    while k < WINDOW:  # sums of the last k values, each shifted by its distance
        rolling[k:] = rolling[k:] + (rolling[:-k] << np.uint64(k))
        k *= 2
    places = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + 1
    bounds = np.searchsorted(places, offsets)
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        found: list[int] = []
        own = places[bounds[row] : bounds[row + 1]].tolist()
        k = 0
        while at < end:
            while k < len(own) and own[k] < at + LEAST:
                k += 1
            at = min(own[k] if k < len(own) else end, at + MOST, end)
            found.append(at)
        yield found


def _inked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray]]:
    """(first row, code points of each row, their bytes without white space, the bounds of rows) for runs of rows."""
    data, offsets = utf8(column)
    for i, j in runs(offsets):
        own = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))  # bytes that begin a code point
        ink = ~_SPACE[own]
        yield i, np.diff(points[at]), np.compress(ink, own), np.concatenate(([0], np.cumsum(ink)))[at]


def _digest(size: int, key: int):
    return lambda chunk: hashlib.blake2b(chunk, digest_size=size, key=key.to_bytes(4, "little")).digest()


def _recipes(size: int, key: int):
    digest = _digest(size, key)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, shas, recipes = np.zeros(batch.num_rows, np.int64), [], []
            for i, points, own, at in _inked(batch.column(1)):
                chars[i : i + len(points)] = points
                raw = own.tobytes()
                for row, ends in enumerate(cuts(own, at)):
                    first = int(at[row])
                    shas.append(hashlib.sha256(raw[first : int(at[row + 1])]).hexdigest())
                    recipes.append(b"".join([digest(raw[a:b]) for a, b in zip([first, *ends], ends)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], names=["doc", "n_chars", "text_sha256", "recipe"])

    return go


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))


def recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = IDENTIFIER, key: int = 0) -> DataFrame:
    """(doc, n_chars, text_sha256, recipe) per row: code points of the original text, the SHA-256 of the text without
    white space, and its recipe of identifiers of size bytes. Null texts count as empty; empty texts have no chunks."""
    ship(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(_recipes(size, key), "doc bigint, n_chars bigint, text_sha256 string, recipe binary")


def uses(found: DataFrame, size: int = IDENTIFIER) -> DataFrame:
    """(identifier, uses) of the chunks of recipes(): the number of places where each stands."""
    at = F.sequence(F.lit(0), F.expr(f"length(recipe) div {size} - 1"))
    each = found.where(F.length("recipe") > 0).select(F.explode(at).alias("i"), "recipe").select(F.expr(f"substring(recipe, int(i) * {size} + 1, {size})").alias("identifier"))
    return each.groupBy("identifier").agg(F.count("*").alias("uses"))


def _bit(digest: bytes, bits: int) -> int:
    return int.from_bytes((digest + bytes(8))[:8], "little") & ((1 << bits) - 1)


def filter_bits(shared: int) -> int:
    """The power of two of the filter's bits for so many identifiers."""
    return min(max((shared * BITS_EACH - 1).bit_length() if shared else 0, LEAST_BITS), MOST_BITS)


def _filter(shared: DataFrame, bits: int) -> bytes:
    """Which values of the low bits the identifiers of shared(identifier) have, a bit each. They come as one row for 64 bits, so
    the driver gets no more than a few times the filter's own size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(x, bits) for x in batch.column(0).to_pylist()], pa.int64())], names=["bit"])

    words = shared.mapInArrow(places, "bit bigint").groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits"))
    out = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.astype("<u8").tobytes()


def contents(docs: DataFrame, shared: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = IDENTIFIER, key: int = 0) -> DataFrame:
    """(identifier, content) of the chunks of docs whose identifier is in shared(identifier), and maybe of some others;
    equal rows at most once for each time that a task's memory of them fills up."""
    spark = docs.sparkSession
    ship(spark)
    bits = filter_bits(shared.count())
    wanted = broadcast(spark, _filter(shared, bits))  # 64 MB at most
    digest = _digest(size, key)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = wanted.value
        given: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for _, _, own, at in _inked(batch.column(1)):
                raw = own.tobytes()
                for row, ends in enumerate(cuts(own, at)):
                    for a, b in zip([int(at[row]), *ends], ends):
                        chunk = raw[a:b]
                        name = digest(chunk)
                        at_bit = _bit(name, bits)
                        if there[at_bit >> 3] >> (at_bit & 7) & 1 and given.get(name) != chunk:
                            out.append((name, chunk))
                            if held > REMEMBERED:
                                given, held = {}, 0
                            given[name] = chunk
                            held += len(chunk) + 100
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["identifier", "content"])
                out = []

    return _rows(docs, id_col, text_col).mapInArrow(go, "identifier binary, content binary")


def verified(scratch: Scratch, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = IDENTIFIER) -> tuple[DataFrame, int]:
    """(recipes(), bytes of an identifier), where no two different chunks of docs have one identifier. Written tables."""
    key = 0
    while True:
        found = scratch.table(recipes(docs, id_col=id_col, text_col=text_col, size=size, key=key), "recipes")
        shared = scratch.table(uses(found, size).where("uses > 1").select("identifier"), "shared")
        chunks = contents(docs, shared, id_col=id_col, text_col=text_col, size=size, key=key)
        if not chunks.groupBy("identifier").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").take(1):
            return found, size
        scratch.drop(found, shared)
        size, key = min(2 * size, 64), key + 1


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = IDENTIFIER) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256, n_chunks).

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and
    blank texts are one group. Of equal texts the one with the most code points in the original text stays, then the
    smallest id; null ids come last, and keep_id is null where all ids of a group are. kept marks the rows whose id is
    keep_id, so repeated rows of that id are all marked. group_size counts rows. An empty table gives no rows; other
    columns of docs are not read.
    """
    found, size = verified(Scratch(docs.sparkSession, "chunks"), docs, id_col=id_col, text_col=text_col, size=size)
    best = F.max(F.struct("n_chars", F.bitwise_not("doc").alias("turned")))  # the complement turns the order of ids round
    groups = found.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("recipe", F.bitwise_not("best.turned").alias("keep_id"), "group_size")
    named = found.join(groups, "recipe")
    return named.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.expr(f"length(recipe) div {size}").alias("n_chunks"))


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each group of equal texts, and so for null, empty and
    blank ones together. It is the row with the most code points, then the smallest id, null ids last; of rows that tie,
    also with other columns, any one. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    at = "_quillon_row"
    numbered = scratch.table(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    found, _ = verified(scratch, numbered.select(F.col(at).alias("row"), F.col(text_col).alias("text")), id_col="row")
    named = found.withColumnRenamed("doc", at).join(numbered.select(at, F.col(id_col).cast("bigint").alias("doc")), at)
    best = F.max(F.struct("n_chars", F.bitwise_not("doc").alias("turned"), F.bitwise_not(at).alias(at)))
    kept = named.groupBy("recipe").agg(best.alias("best")).select(F.bitwise_not(f"best.{at}").alias(at))
    return numbered.join(kept, at, "left_semi").drop(at)
