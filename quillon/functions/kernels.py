"""Scalar kernels as Column expressions: Hamming and cosine MaxSim, calibration to binary words, tokens of a text.

A binary multivector is an array of BIGINT, one word a token with 48 significant bits; a float multivector is an array
of arrays. NULL in gives NULL out; an empty multivector on either side scores 0.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BITS = 48
MASK = (1 << BITS) - 1
#: Query tokens that are written out as a sum; longer queries are folded.
UNROLLED = 32


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Bits in which the low 48 bits of two words differ."""
    return F.bit_count(_column(a).bitwiseXOR(_column(b)).bitwiseAND(F.lit(MASK)))


def _nearest(word: Column, doc: Column) -> Column:
    return F.lit(BITS) - F.array_min(F.transform(doc, lambda d: hamming_distance(word, d)))


def hamming_maxsim(query: Column | str | Sequence[int], doc: Column | str) -> Column:
    """Sum over the query's words of 48 less the least distance to a word of the document, as FLOAT.

    A query given as a sequence of ints is a constant and written out, which saves a level of lambdas.
    """
    doc = _column(doc)
    if not isinstance(query, (Column, str)):
        own = [int(w) & MASK for w in query]
        if len(own) <= UNROLLED:
            total = sum((_nearest(F.lit(w), doc) for w in own), F.lit(0))
            return F.when(doc.isNotNull(), F.when(F.size(doc) == 0, F.lit(0)).otherwise(total)).cast("float")
        query = F.array(*(F.lit(w) for w in own))
    query = _column(query)
    total = F.aggregate(query, F.lit(0), lambda s, w: s + _nearest(w, doc))
    empty = (F.size(doc) == 0) | (F.size(query) == 0)
    return F.when(doc.isNotNull() & query.isNotNull(), F.when(empty, F.lit(0)).otherwise(total)).cast("float")


def words_of_bytes(tokens: Column | str) -> Column:
    """BIGINT words of an array of BINARY rows of 8 bytes: little-endian, low 48 bits. Other lengths raise."""

    def word(row: Column) -> Column:
        digits = F.hex(row)
        value = F.conv(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(BITS // 8)))), 16, 10).cast("bigint")
        return F.when(F.length(row) == 8, value).otherwise(F.raise_error(F.lit("binary token rows must have 8 bytes")).cast("bigint"))

    return F.transform(_column(tokens), word)


def bytes_of_words(words: Sequence[int]) -> list[bytes]:
    return [(int(w) & MASK).to_bytes(8, "little") for w in words]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(tokens: Column | str) -> Column:
    """Each token over its Euclidean length; tokens of length 0 stay zero."""

    def unit(v: Column) -> Column:
        return _bound(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)))

    return F.transform(_column(tokens), unit)


def cosine_maxsim(query: Column | str, doc: Column | str, *, unit: bool = False) -> Column:
    """Sum over the query's tokens of the greatest cosine to a token of the document, as DOUBLE.

    unit: both sides are normalized already. Tokens of different widths raise.
    """
    query, doc = _column(query), _column(doc)
    width_q, width_d = F.size(F.element_at(query, 1)), F.size(F.element_at(doc, 1))
    q, d = (query, doc) if unit else (normalized(query), normalized(doc))
    total = _bound(d, lambda own: F.aggregate(q, F.lit(0.0), lambda s, v: s + F.array_max(F.transform(own, lambda w: dot(v, w)))))
    empty = (F.size(doc) == 0) | (F.size(query) == 0)
    checked = F.when(empty, F.lit(0.0)).when(width_q != width_d, F.raise_error(F.lit("query and document dimensions differ")).cast("double")).otherwise(total)
    return F.when(doc.isNotNull() & query.isNotNull(), checked)


def literal(vectors: Sequence[Sequence[float]]) -> Column:
    """A constant array of arrays; as JSON, so that the plan holds one value."""
    rows = [[float(x) for x in v] for v in vectors]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def cosine_to(query: Sequence[Sequence[float]], doc: Column | str) -> Column:
    """cosine_maxsim() of a constant query, which is normalized once."""
    units = []
    for v in query:
        norm = math.sqrt(sum(float(x) ** 2 for x in v)) or 1.0
        units.append([float(x) / norm for x in v])
    return cosine_maxsim(literal(units), normalized(doc), unit=True)


def text_tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit("[a-z0-9]+"), F.lit(0))


def padded(vector: Column, bits: int = BITS) -> Column:
    """The vector with zeros up to the number of bits; longer ones raise."""
    short = F.concat(vector.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(bits) - F.size(vector), F.lit(0))))
    return F.when(F.size(vector) <= bits, short).otherwise(F.raise_error(F.lit(f"token vectors must have at most {bits} dimensions")).cast("array<float>"))


def binary_words(tokens: Column | str, thresholds: Sequence[float], rotation: Sequence[Sequence[float]] | None = None) -> Column:
    """One BIGINT word a token: bit i is set where dimension i lies strictly above its threshold.

    Vectors are padded to 48 dimensions first, and multiplied by the rotation (as a row) where there is one: by one matrix
    product for each Arrow batch of tokens.
    """
    if len(thresholds) != BITS:
        raise ValueError(f"expected {BITS} thresholds, got {len(thresholds)}")
    if rotation is not None:
        return _rotated_words(tuple(map(float, thresholds)), rotation)(_column(tokens).cast("array<array<double>>"))
    limits = F.array(*(F.lit(float(t)).cast("float") for t in thresholds))

    def word(vector: Column) -> Column:
        bits = F.zip_with(padded(vector), limits, lambda x, t: x > t)
        place = F.transform(bits, lambda b, i: F.when(b, F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(place, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))

    return F.transform(_column(tokens), word)


def _rotated_words(thresholds: tuple[float, ...], rotation: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    bits = BITS

    @F.arrow_udf("array<bigint>")
    def words(column: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        sizes = np.array([x or 0 for x in column.value_lengths().to_pylist()], np.int64)
        each = column.flatten()
        widths = np.array([-1 if x is None else x for x in each.value_lengths().to_pylist()], np.int64)
        if (widths > bits).any():
            raise ValueError(f"token vectors must have at most {bits} dimensions")
        some = np.maximum(widths, 0)
        rows = np.zeros((len(each), bits))
        at = np.repeat(np.arange(len(each)), some)
        rows[at, np.arange(len(at)) - np.repeat(np.cumsum(some) - some, some)] = each.flatten().to_numpy(zero_copy_only=False)
        above = (rows @ np.array(rotation, np.float64)).astype(np.float32) > np.array(thresholds, np.float32)
        own = pa.array(above @ (1 << np.arange(bits, dtype=np.int64)), pa.int64(), mask=widths < 0)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(offsets, own)

    return words


def register(spark: SparkSession) -> None:
    """Make the kernels SQL functions of the session: hamming_maxsim over words, hamming_maxsim_bytes over rows of eight
    bytes, words_of_bytes, hamming_distance, text_tokens."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION hamming_distance(a BIGINT, b BIGINT) RETURNS INT
        RETURN bit_count((a ^ b) & {MASK}L)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION hamming_maxsim(q ARRAY<BIGINT>, d ARRAY<BIGINT>) RETURNS FLOAT
        RETURN CASE WHEN q IS NULL OR d IS NULL THEN CAST(NULL AS FLOAT) WHEN size(q) = 0 OR size(d) = 0 THEN CAST(0 AS FLOAT)
        ELSE CAST(aggregate(q, 0, (s, a) -> s + {BITS} - array_min(transform(d, b -> bit_count((a ^ b) & {MASK}L)))) AS FLOAT) END""")
    digits = ", ".join(f"substr(hex(t), {2 * k + 1}, 2)" for k in reversed(range(BITS // 8)))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION words_of_bytes(rows ARRAY<BINARY>) RETURNS ARRAY<BIGINT>
        RETURN transform(rows, t -> CASE WHEN length(t) = 8 THEN CAST(conv(concat({digits}), 16, 10) AS BIGINT) ELSE CAST(raise_error('binary token rows must have 8 bytes') AS BIGINT) END)""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming_maxsim_bytes(q ARRAY<BINARY>, d ARRAY<BINARY>) RETURNS FLOAT RETURN hamming_maxsim(words_of_bytes(q), words_of_bytes(d))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), '[a-z0-9]+', 0)")
