"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment of words.

The n-grams of the test items are counted over all documents. Those that occur are an item's seeds, but for common ones:
where an n-gram is in more than COMMON documents, it is left out if SEED_SHARE of the item's n-grams are rarer and occur,
too. So an item keeps all its seeds where few of its n-grams occur, and the rarer ones where all are common. Where a
document has a seed, the words around it are aligned with the item. An alignment's score is its share of a perfect one,
so paraphrased or edited copies are found as well as exact ones. Items of few words are looked for by exact match of all
their words. A word here is a run of ASCII letters and digits and of other characters than ASCII; in scripts without
blanks each character is one. Case is ignored, that of accented Latin-1 letters included.

Items are collected in blocks of bounded size, and each block's index is broadcast to two passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._cluster import broadcast, ship
from quillon.llm import _text
from quillon.llm._text import runs, shingles, utf8

SEED_WORDS = 3
#: Documents from which on an n-gram is common, and the share of an item's n-grams that stay seeds, the rarest first.
COMMON, SEED_SHARE = 1_000, 0.75
#: Items of fewer words are not aligned, as parts of them cannot be told from chance; they are found as a whole.
LEAST_WORDS = 8
#: What a matching word earns, and what another or a missing word costs.
MATCH, MISMATCH, GAP = 2, 1, 1
#: Share of the perfect score from which on a passage is one of the item.
LIMIT = 0.5
#: Characters of items in a block.
BLOCK_CHARS = 8_000_000
_FILTER_BITS = 20
_BETWEEN = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _text.words(data, offsets, _BETWEEN, accents=True, unspaced=True)


@dataclass
class Index:
    ids: list[int | None]
    item_words: list[np.ndarray]
    keys: np.ndarray  # sorted n-grams
    entries: np.ndarray  # bounds of each key in the next two
    items: np.ndarray
    places: np.ndarray
    sieve: np.ndarray
    short: dict[int, tuple[np.ndarray, list[list[int | None]]]]  # by number of words: sorted hashes of whole items, and their ids


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return out


def build_index(items: list[tuple[int | None, str]], seed_words: int, least_words: int) -> Index:
    data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
    _, _, hashes, bounds = words(data, offsets)
    ids, own_words, grams, of_item, place = [], [], [], [], []
    least, whole = max(least_words, seed_words), {}
    for (item, _), i, j in zip(items, bounds, bounds[1:]):
        if j - i < least:
            if j > i:
                whole.setdefault(int(j - i), {}).setdefault(int(shingles(hashes[i:j], int(j - i))[0]), []).append(item)
            continue
        g = shingles(hashes[i:j], seed_words)
        grams.append(g)
        of_item.append(np.full(len(g), len(ids)))
        place.append(np.arange(len(g)))
        ids.append(item)
        own_words.append(hashes[i:j])
    short = {size: (np.array(sorted(own), np.uint64), [own[h] for h in sorted(own)]) for size, own in whole.items()}
    return _index(ids, own_words, *(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (grams, of_item, place)), short)


def _index(ids, own_words, grams, of_item, place, short) -> Index:
    order = np.argsort(grams, kind="stable")
    keys, first = np.unique(grams[order], return_index=True)
    return Index(ids, own_words, keys.astype(np.uint64), np.concatenate((first, [len(order)])), of_item[order].astype(np.int64), place[order].astype(np.int64), _sieve(keys.astype(np.uint64)), short)


def seeds_only(index: Index, counts: np.ndarray, share: float, common: int) -> Index:
    """The index with each item's n-grams that occur. Of these, the ones in more than ``common`` documents go, but for
    the rarest ``share`` of the item's n-grams; ties by hash. counts: documents that have each n-gram."""
    key_of = np.repeat(np.arange(len(index.keys)), np.diff(index.entries))
    order = np.argsort(index.items, kind="stable")
    bounds = np.searchsorted(index.items[order], np.arange(len(index.ids) + 1))
    keep = np.zeros(len(key_of), bool)
    for first, last in zip(bounds, bounds[1:]):
        at = order[first:last]
        own = np.unique(key_of[at])
        there = own[counts[own] > 0]
        ranked = there[np.argsort(counts[there], kind="stable")]
        seeds = ranked[(counts[ranked] <= common) | (np.arange(len(ranked)) < np.ceil(share * len(own)))]
        keep[at] = np.isin(key_of[at], seeds)
    return _index(index.ids, index.item_words, index.keys[key_of[keep]], index.items[keep], index.places[keep], index.short)


def _hits(index: Index, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in grams, key numbers) of the n-grams that the index has."""
    at = np.flatnonzero(index.sieve[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at) or not len(index.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.minimum(np.searchsorted(index.keys, grams[at]), len(index.keys) - 1)
    found = index.keys[key] == grams[at]
    return at[found], key[found]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment; end is the number of words of text up to its end; of equally good ones, that of the fewest words of the item."""
    steps = np.arange(len(text)) * GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        reach = np.maximum(row[:-1] + np.where(text == word, MATCH, -MISMATCH), row[1:] - GAP)
        np.maximum(reach, 0, out=reach)
        row[1:] = np.maximum.accumulate(reach + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def passages(index: Index, own: np.ndarray, seed_words: int, limit: float) -> Iterator[tuple[int, float, int, int]]:
    """(item number, score, first word, end word) of each passage of the words ``own`` that is one of an item."""
    at, key = _hits(index, shingles(own, seed_words)) if len(own) >= seed_words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(at):
        return
    n = index.entries[key + 1] - index.entries[key]
    entry = np.repeat(index.entries[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, item, place = np.repeat(at, n), index.items[entry], index.places[entry]
    for k in np.unique(item):
        wanted = index.item_words[k]
        size = len(wanted)
        room = int(size * (1 + MATCH / GAP * (1 - limit)))  # an alignment above the limit reaches no further from a seed
        starts = np.unique(at[item == k] - place[item == k])
        first = np.maximum(starts - room + size, 0)
        last = np.minimum(starts + room, len(own))
        opens = np.flatnonzero(np.concatenate(([True], first[1:] > np.maximum.accumulate(last)[:-1])))
        for i, j in zip(opens, [*opens[1:], len(starts)]):
            windows = [(int(first[i]), int(last[i:j].max()))]
            while windows:  # the best passage of a window, then what is left of it and right of it
                lo, hi = windows.pop()
                text = own[lo:hi]
                # no alignment earns more than the item's words that the text has
                if np.isin(wanted, text).sum() < limit * size:
                    continue
                score, end = align(wanted, text)
                if score >= limit * MATCH * size:
                    _, back = align(wanted[::-1], text[:end][::-1])
                    yield int(k), score / (MATCH * size), lo + end - back, lo + end
                    windows += [(lo, lo + end - back), (lo + end, hi)]


def exact(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, first word, end word) of each copy of a short item in the words of rows; copies do not overlap."""
    for size, (keys, ids) in index.short.items():
        if len(hashes) < size:
            continue
        grams = shingles(hashes, size)
        key = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        at = np.flatnonzero(keys[key] == grams)
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + size <= bounds[row + 1]
        free: dict[tuple[int, int], int] = {}
        for i, k, n in zip(row[inside].tolist(), key[at[inside]].tolist(), at[inside].tolist()):
            if n >= free.get((i, k), 0):
                free[i, k] = n + size
                for item in ids[k]:
                    yield i, item, n, n + size


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, seed_share: float = SEED_SHARE, common: int = COMMON, least_words: int = LEAST_WORDS, limit: float = LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per passage of a document that is one of a test item: (doc_id, item_id, score, first_byte, end_byte).

    score is the alignment's share of a perfect one, at least limit and at most 1; the bytes bound the passage in the
    UTF-8 text. A document has a row for each item and each separate passage. Items of fewer than least_words words (or
    seed_words) must be met word for word and have score 1; one of a single word is in each text that has the word. Null
    texts, texts without words and items that are null or have no words have no rows; null ids stay null. Repeated
    documents have their rows each, repeated items too. An empty table on either side gives no rows; other columns are
    not read. An edited copy is missed where it shares no seed with its item.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = "doc_id bigint, item_id bigint, score double, first_byte bigint, end_byte bigint"
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        whole = build_index(sorted(((r["item"], r["text"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])), seed_words, least_words)
        part = texts.mapInArrow(_search(spark, texts, whole, seed_words, seed_share, common, limit), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _search(spark, texts: DataFrame, whole: Index, seed_words: int, share: float, common: int, limit: float):
    shared = broadcast(spark, whole)  # bounded by block_chars

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in runs(offsets):
                _, _, hashes, bounds = words(data, offsets[i : j + 1])
                if len(hashes) < seed_words:
                    continue
                at, key = _hits(shared.value, shingles(hashes, seed_words))
                doc = np.searchsorted(bounds, at, "right") - 1
                inside = at + seed_words <= bounds[doc + 1]
                pairs = np.unique(doc[inside] * len(counts) + key[inside])
                np.add.at(counts, pairs % len(counts), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["key", "n"])

    counts = np.zeros(len(whole.keys), np.int64)
    if len(counts):
        for r in texts.select("text").mapInArrow(tally, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
            counts[r["key"]] = r["n"]
    seeds = broadcast(spark, seeds_only(whole, counts, share, common))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = seeds.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows: list[tuple] = []
            for i, j in runs(offsets):
                starts, ends, hashes, bounds = words(data, offsets[i : j + 1])
                for k, item, first, end in exact(index, hashes, bounds):
                    rows.append((i + k, item, 1.0, int(starts[first]) - int(offsets[i + k] - offsets[i]), int(ends[end - 1]) - int(offsets[i + k] - offsets[i])))
                if len(hashes) < seed_words:
                    continue
                at, _ = _hits(index, shingles(hashes, seed_words))
                for k in np.unique(np.searchsorted(bounds, at, "right") - 1):
                    lo, base = int(bounds[k]), int(offsets[i + k] - offsets[i])
                    for item, score, first, end in passages(index, hashes[lo : bounds[k + 1]], seed_words, limit):
                        rows.append((i + int(k), index.ids[item], score, int(starts[lo + first]) - base, int(ends[lo + end - 1]) - base))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "item_id", "score", "first_byte", "end_byte"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and item with a passage: (doc_id, item_id, score, passages), with the best score.

    Rows of one id are one document, as are those with null ids, and items of one id one item; passages counts those of
    all of them. Otherwise as find(); an empty table on either side gives no rows.
    """
    return find(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("passages"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those whose id has a passage of an item; all columns stay. Rows with a null id stay."""
    leaks = find(docs, benchmark, id_col=id_col, **options).where("doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(leaks, id_col, "left_anti")
