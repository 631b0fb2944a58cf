"""Token ids of whole texts, and exact token counts.

The encoder is the tokenizers library with a file given by path. For byte-level BPE files that split as GPT-2 does, a
text may be cut before any blank or line feed that follows ink, and between a letter and punctuation, without changing its
ids; so each distinct piece is encoded once by the library and remembered, up to a bounded number of pieces. A piece is
remembered with all its bytes, and looked up by these; longer ones than WIDE are not remembered. Other files go to the
library whole.

Token counts come from an exact length histogram. Documents are aggregated by encoded length, which leaves a table that
grows with the number of distinct lengths only; suffix sums over it answer totals, quantiles and truncated totals for
every context limit.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, ship
from quillon.llm._text import block, mix, padded, runs, utf8

#: Bytes of a piece that is remembered, at most.
WIDE = 32
#: Pieces that an encoder remembers: about 60 MB. Beyond, it forgets them all.
REMEMBERED = 1_000_000
#: Lengths summed by one task at a time when the histogram is summed up.
STRIDE = 4096
_PLAIN = re.compile(r"[ \n]\S{1,64}").fullmatch

_U = np.uint64
_CUT = np.isin(np.arange(256), [0x20, 0x0A])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Second bytes of the letters of U+00C0 to U+00FF.
_LATIN = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def pieces(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of each row: cut at its start, before any blank or line feed that follows a
    character that is no white space, and before any of the marks that follows a letter of ASCII or Latin-1. A character
    of three bytes that might be white space is not cut after."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    if n > 1:
        inside = _CUT[data[1:]] & ~_WHITE[data[:-1]]
        inside[1:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
        if n > 3:
            inside[2:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
        mark = marks[data[1:]]
        latin = np.zeros(n - 1, bool)
        latin[1:] = (data[:-2] == 0xC3) & _LATIN[data[1:-1]]
        first[1:n] = inside | mark & (_LETTER[data[:-1]] | latin)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first[:n])
    return starts, np.append(starts[1:], n) if len(starts) else starts


def contents(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bytes) of pieces of at most WIDE bytes: a row of WIDE // 8 integers each, with zeros
    after its end. Pieces are equal when these and their sizes are."""
    whole = padded(data)
    own = np.zeros((len(starts), WIDE // 8), np.uint64)
    hashes = mix(size.astype(np.uint64))
    rest = np.arange(len(starts))
    for k in range(WIDE // 8):
        rest = rest[size[rest] > 8 * k] if k else rest
        own[rest, k] = block(whole, starts[rest] + 8 * k, size[rest] - 8 * k)
        hashes[rest] = mix((hashes[rest] + _U(k)) ^ own[rest, k])
    return hashes, own


class Encoder:
    """Ids of texts as the tokenizers library gives them with add_special_tokens=False.

    Pieces are remembered by 64-bit hashes: keys in order, with each one's bytes and the place of its ids in a pool. Of
    two pieces with one hash, one is remembered and the other goes to the library whenever it is met.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", []))
        )
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocabulary.values(), default=0).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] in ("Ġ", "Ċ")]] = True  # blank, line feed
        # punctuation parts from a letter before it, but not within an added token
        within = {b for t in spec.get("added_tokens", []) for a, b in zip(t["content"], t["content"][1:]) if a.isalpha()}
        self.marks = np.isin(np.arange(256), [ord(c) for c in string.punctuation if c not in within])
        self.forget()

    @classmethod
    def load(cls, path: str) -> Encoder:
        """The encoder of this process for a file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes, self.long = np.zeros((0, WIDE // 8), np.uint64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _pooled(self, ids: np.ndarray) -> int:
        """Put ids in the pool; their place."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(ids), self.used), self.kind)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each text, plain ones in one go: each of these begins with its only white space, so their ids part there."""
        at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32)
        plain = [k for k, t in enumerate(texts) if _PLAIN(t)]
        rest = range(len(texts))
        if plain:
            ids = np.array(self.library.encode("".join([texts[k] for k in plain]), add_special_tokens=False).ids, self.kind)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) == len(plain):
                at[plain] = self._pooled(ids) + cut
                size[plain] = np.diff(np.append(cut, len(ids)))
                done = set(plain)
                rest = [k for k in rest if k not in done]
        for k, ids in zip(rest, self._whole([texts[k] for k in rest])):
            at[k], size[k] = self._pooled(ids), len(ids)
        return at, size

    def _known(self, hashes: np.ndarray, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, whether it has this hash, whether it has these bytes) of pieces."""
        slot = np.searchsorted(self.keys, hashes)
        there = slot < len(self.keys)
        there[there] = self.keys[slot[there]] == hashes[there]
        same = there.copy()
        same[there] = (self.bytes[slot[there]] == own[there]).all(axis=1) & (self.long[slot[there]] == size[there])
        return slot, there, same

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row's) of rows of UTF-8."""
        base = int(offsets[0])
        data, offsets = data[base : int(offsets[-1])], offsets - base
        raw = data.tobytes()
        if not self.cuttable:
            each = self._whole([raw[i:j].decode("utf-8", "replace") for i, j in zip(offsets, offsets[1:])])
            return np.concatenate([np.zeros(0, self.kind), *each]), np.cumsum([0, *map(len, each)])
        starts, ends = pieces(data, offsets, self.marks)
        text = lambda k: raw[starts[k] : ends[k]].decode("utf-8", "replace")
        size = ends - starts
        short = np.flatnonzero(size <= WIDE)
        hashes, own = contents(data, starts[short], size[short])
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        slot, there, same = self._known(distinct, own[example], size[short[example]])
        if len(self.keys) + int((~there).sum()) > REMEMBERED:
            self.forget()
            slot, there, same = self._known(distinct, own[example], size[short[example]])
        if len(new := np.flatnonzero(~there)):
            at, n = self._encoded([text(k) for k in short[example[new]].tolist()])
            place = slot[new]
            self.keys, self.at, self.size = np.insert(self.keys, place, distinct[new]), np.insert(self.at, place, at), np.insert(self.size, place, n)
            self.bytes, self.long = np.insert(self.bytes, place, own[example[new]], axis=0), np.insert(self.long, place, size[short[example[new]]])
        slot = np.searchsorted(self.keys, distinct)[which]
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], n[short] = self.at[slot], self.size[slot]
        odd = np.ones(len(starts), bool)  # pieces that are too long, or another of the same hash
        odd[short] = (self.bytes[slot] != own).any(axis=1) | (self.long[slot] != size[short])
        kept = self.used
        if len(odd := np.flatnonzero(odd)):
            texts, which = np.unique(np.array([text(k) for k in odd.tolist()], object), return_inverse=True)
            at_odd, n_odd = self._encoded(texts.tolist())
            at[odd], n[odd] = at_odd[which], n_odd[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(at - upto[:-1], n) + np.arange(upto[-1])]
        self.used = kept
        return ids, upto[np.searchsorted(starts, offsets)]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode_bytes(*utf8(pa.array(list(texts), pa.large_string())))
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]


def encoded(encoder: Encoder, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds of each row's ids) for runs of rows of a string column; null texts are empty."""
    data, offsets = utf8(column)
    for i, j in runs(offsets):
        yield i, *encoder.encode_bytes(data, offsets[i : j + 1])


def token_lengths(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_tokens) for each row of docs: the ids of its whole text, without special tokens. Null texts have none."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for first, _, bounds in encoded(encoder, batch.column(1)):
                n[first : first + len(bounds) - 1] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length: how many documents have it, and the suffix sums over all lengths.

    Columns: n_tokens, n_docs; docs_longer and tokens_longer count documents above this length and their tokens;
    total_docs, total_tokens; truncated_total, the tokens left when each document is cut to n_tokens; and
    quantile, the share of documents of at most this length. Null lengths are left out; no rows give no rows.

    The counts are written to the shared folder once. The sums run over ranges of STRIDE lengths first, and over the
    ranges' totals after that.
    """
    n = F.col(length_col)
    counts = lengths.where(n.isNotNull()).groupBy(n.cast("bigint").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    counts = Scratch(lengths.sparkSession, "tokens").table(counts.withColumn("stride", F.expr(f"n_tokens div {STRIDE}")), "lengths")
    ranges = counts.groupBy("stride").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    above = Window.orderBy(F.desc("stride")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("stride")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "stride", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(every).alias("total_docs"), F.sum("tokens").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("stride").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.select("stride", "n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0)).alias("t"))
    out = own.join(ranges, "stride").select("n_tokens", "n_docs", (F.col("d") + F.col("docs_above")).alias("docs_longer"), (F.col("t") + F.col("tokens_above")).alias("tokens_longer"), "total_docs", "total_tokens")
    return out.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def limits(histogram: DataFrame, context_limits: Sequence[int]) -> DataFrame:
    """For each context limit: total_tokens, truncated_total and docs_cut, the documents above it.

    The limits need not be lengths of the histogram. An empty histogram gives zero totals.
    """
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in context_limits], "context_limit bigint")
    parts = []
    for limit in sorted({int(x) for x in context_limits}):
        n = F.col("n_tokens")
        parts += [F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")).alias(f"t{limit}"), F.sum(F.when(n > limit, F.col("n_docs"))).alias(f"c{limit}")]
    row = histogram.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total"), *parts)
    stacked = row.select("total", F.explode(F.array(*(F.struct(F.lit(x).cast("bigint").alias("context_limit"), F.col(f"t{x}").alias("t"), F.col(f"c{x}").alias("c")) for x in sorted({int(x) for x in context_limits})))).alias("at"))
    return wanted.distinct().join(stacked.select("total", "at.*"), "context_limit", "left").select(
        "context_limit", F.coalesce("total", F.lit(0)).alias("total_tokens"), F.coalesce("t", F.lit(0)).alias("truncated_total"), F.coalesce("c", F.lit(0)).alias("docs_cut")
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(float(x),) for x in shares], "share double")
    parts = [F.min(F.when(F.col("quantile") >= F.lit(float(x)), F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(shares)]
    stacked = histogram.agg(*parts).select(F.explode(F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)))).alias("at"))
    return wanted.distinct().join(stacked.select("at.*"), "share", "left")

