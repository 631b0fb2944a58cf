"""Alignment of two tokenizers' ids over the same bytes.

A text is encoded by both tokenizers. Where a token of each ends at the same byte, the text is cut: the tokens of both sides
between two cuts are a group, and each pair of them is a link. A pair of ids counts in how many documents it is linked.

Counting and scoring are by stripes of the first side's ids. Each task sums up what its documents hold, for one pair at a
time, before the shuffle; a stripe's sums are added (``np.add.at``) into a dense matrix of its ids by the other side's
ids, whose row maxima are the best counts. Links lie in the shared folder, packed by stripe and run of documents; the
stripes' counts go to the same partitions as their links, ahead of them, and so score them as a stream.

Both sides are ``(name of library, file)``: byte-level BPE of the tokenizers library, or a model of sentencepiece that adds
a blank before the text. The first side is given the text with that blank. Strings of special tokens are plain text. A
token's bytes are its entry, decoded (byte level), or its piece in UTF-8 with U+2581 as a blank and <0xHH> as the byte HH.

Texts are cut into chunks before blanks that follow ink, where both tokenizers must part; each distinct chunk is encoded
and aligned once a process and remembered, up to a bounded number.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, ship
from quillon.llm._text import runs, utf8

#: Stripes of the first side's ids: id modulo STRIPES. A stripe's matrix has a row for each of its ids.
STRIPES = 128
#: Bytes of text in a run, whose links are packed together; a longer text is a run of its own.
RUN = 1 << 20
#: Chunks that a process remembers. Beyond, it forgets them all.
REMEMBERED = 400_000
#: Bytes of chunks encoded as one text.
TOGETHER = 1 << 17
#: Pairs whose sums a task holds before it passes them on, and pairs in a row of counts.
HELD, PASSED = 1_000_000, 1 << 20
#: Runs scored by one task against one stripe.
SCORED_RUNS = 4096
#: Links expanded at a time.
EXPANDED = 1 << 21

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_JOINED = re.compile(rb" (?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf]){1,64}").fullmatch


class ByteLevel:
    """Byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.parts_at_blanks = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        # printable bytes stand for themselves, the others for code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(plain))
        sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = added[k] if k in added else bytes(sign[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that adds a blank; texts are given with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(own)]
        # no piece goes on after a blank, and nothing is normalized away
        self.parts_at_blanks = not any(re.search("[^▁]▁", p) for p in own) and self._identity()

    def _identity(self) -> bool:
        probe = "a  Ａﬁ é "
        return b"".join(self.bytes[k] for k in self.library.encode(probe)) == b" " + probe.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


SIDES = {"tokenizers": ByteLevel, "sentencepiece": Pieces}


def _flat(each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each begins)."""
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, size of them."""
    upto = np.cumsum(size)
    return np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


class Aligner:
    """Both tokenizers, and the chunks that have been aligned: numbers of ids, groups and links, the groups as text, and
    the links as pairs (first id times the other side's number of ids, plus the other id) with how often they occur."""

    _loaded: dict[tuple, Aligner] = {}

    def __init__(self, first: tuple[str, str], other: tuple[str, str]):
        self.sides = [SIDES[kind](path) for kind, path in (first, other)]
        self.widths = [len(s.bytes) for s in self.sides]
        self.tables = [_flat(s.bytes) for s in self.sides]
        self.names = [[str(k) for k in range(w)] for w in self.widths]
        self.cuts = all(s.parts_at_blanks for s in self.sides)
        self.forget()

    @classmethod
    def load(cls, first: tuple[str, str], other: tuple[str, str]) -> Aligner:
        """The aligner of this process for two files."""
        if (first, other) not in cls._loaded:
            cls._loaded[first, other] = cls(first, other)
        return cls._loaded[first, other]

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.texts: list[str] = []
        #: a row for each chunk: whether its bytes agree, ids of both sides, groups, links, first pair, number of pairs
        self.facts = np.zeros((1 << 12, 7), np.int64)
        self.pool, self.used = np.zeros((2, 1 << 14), np.int64), 0

    def chunks(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin in rows that end at ``ends``: at each row, and before blanks that follow ink. After characters
        of three bytes that might be white space, and two of Latin-1, nothing is cut."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        if self.cuts and n > 1:
            inside = (data[1:] == 0x20) & ~_BLANK[data[:-1]]
            inside[1:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
            if n > 3:
                inside[2:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
            # other controls are no white space to one library and may be to the other
            inside &= (data[:-1] > 0x20) & (data[:-1] != 0x7F)
            first[1:n] = inside
            first[ends[1:] - 1] = False  # a blank alone is no text to the other library
        first[ends[:-1]] = True
        return np.flatnonzero(first[:n])

    def _ids(self, chunks: list[bytes]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """The chunks in another order, and of each side: (ids of all chunks, number of ids of each). Chunks of a blank and ink
        go in texts of a bounded size, which the libraries part at their blanks; where that can't be seen from the bytes,
        they go one by one."""
        plain = [c for c in chunks if _JOINED(c)] if self.cuts else []
        rest = [c for c in chunks if not _JOINED(c)] if self.cuts else chunks
        upto = np.cumsum([len(c) for c in plain], dtype=np.int64)
        parts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) + 1 if plain else 0, TOGETHER)))
        parts = [*parts.tolist(), len(plain)] if plain else [0]
        out = []
        for side, (_, starts) in zip(self.sides, self.tables):
            every, each = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def one_by_one(some: list[bytes]) -> None:
                for k in range(0, len(some), 10_000):
                    found = side.encode([c.decode("utf-8", "replace") for c in some[k : k + 10_000]])
                    every.append(np.array([x for own in found for x in own], np.int64))
                    each.append(np.array([len(own) for own in found], np.int64))

            for i, j in zip(parts, parts[1:]):
                ids = np.array(side.encode([b"".join(plain[i:j]).decode()])[0], np.int64)
                stops, ends = np.cumsum(np.diff(starts)[ids]), upto[i:j] - (upto[i - 1] if i else 0)
                at = np.searchsorted(stops, ends)
                if len(stops) and stops[-1] == ends[-1] and (stops[np.minimum(at, len(stops) - 1)] == ends).all():
                    every.append(ids)
                    each.append(np.diff(at, prepend=-1))
                else:
                    one_by_one(plain[i:j])
            one_by_one(rest)
            out.append((np.concatenate(every), np.concatenate(each)))
        return plain + rest, out

    def _bytes(self, side: int, ids: np.ndarray) -> np.ndarray:
        data, starts = self.tables[side]
        return data[_ranges(starts[ids], starts[ids + 1] - starts[ids])]

    def _learn(self, chunks: list[bytes]) -> None:
        """Align chunks that are not remembered."""
        chunks, sides = self._ids(chunks)
        sizes = np.array([len(c) for c in chunks], np.int64)
        want = np.frombuffer(b"".join(chunks), np.uint8)
        good = np.ones(len(chunks), bool)
        lengths = []
        for k, (ids, n) in enumerate(sides):
            starts = self.tables[k][1]
            lengths.append(starts[ids + 1] - starts[ids])
            owner = np.repeat(np.arange(len(chunks)), n)
            good &= np.bincount(owner, lengths[k], len(chunks)).astype(np.int64) == sizes
        for k, (ids, n) in enumerate(sides):  # the bytes themselves, of chunks whose lengths agree
            owner = np.repeat(good, n)
            have, own = self._bytes(k, ids[owner]), want[np.repeat(good, sizes)]
            wrong = np.repeat(np.flatnonzero(good), sizes[good])[have != own]
            good[wrong] = False
        ids, stops, owners = [], [], []
        for k, (every, n) in enumerate(sides):
            keep = np.repeat(good, n)
            owner = np.repeat(np.arange(len(chunks)), n)[keep]
            ids.append(every[keep])
            stops.append(np.cumsum(lengths[k][keep]))
            owners.append(owner)
        at = np.searchsorted(stops[1], stops[0])
        cuts = stops[0][stops[1][np.minimum(at, len(stops[1]) - 1)] == stops[0]] if len(stops[1]) else stops[1]
        groups = [np.searchsorted(cuts, s) for s in stops]
        first_of = np.searchsorted(cuts, np.cumsum(sizes[good]))  # the last group of each good chunk
        group_owner = np.repeat(np.flatnonzero(good), np.diff(np.concatenate(([-1], first_of))))
        n_ids = [np.bincount(g, minlength=len(cuts)) for g in groups]
        # distinct ids of a group with how often they occur, then their pairs
        distinct = [_summed(g * w + i, np.ones(len(i), np.int64)) for g, w, i in zip(groups, self.widths, ids)]
        (key_a, times_a), (key_b, times_b) = distinct
        group_a, id_a, group_b, id_b = key_a // self.widths[0], key_a % self.widths[0], key_b // self.widths[1], key_b % self.widths[1]
        begin_b = np.searchsorted(group_b, np.arange(len(cuts) + 1))
        many = begin_b[group_a + 1] - begin_b[group_a]
        pair_keys, pair_times = [], []
        edges = np.concatenate(([0], np.cumsum(many)))
        i = 0
        while i < len(many):  # a bounded number of pairs at a time
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + EXPANDED, "right")) - 1)
            right = _ranges(begin_b[group_a[i:j]], many[i:j])
            pair_keys.append(np.stack((np.repeat(group_owner[group_a[i:j]], many[i:j]), np.repeat(id_a[i:j], many[i:j]) * self.widths[1] + id_b[right])))
            pair_times.append(np.repeat(times_a[i:j], many[i:j]) * times_b[right])
            i = j
        owner, pair = np.concatenate([np.zeros((2, 0), np.int64), *pair_keys], axis=1)
        times = np.concatenate([np.zeros(0, np.int64), *pair_times])
        per_chunk = np.bincount(owner, minlength=len(chunks))
        base = len(self.memo)
        while base + len(chunks) > len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        facts = self.facts[base : base + len(chunks)]
        facts[:, 0] = good
        facts[:, 1], facts[:, 2] = (np.bincount(o, minlength=len(chunks)) for o in owners)
        facts[:, 3] = np.bincount(group_owner, minlength=len(chunks))
        facts[:, 4] = np.bincount(group_owner, n_ids[0] * n_ids[1], len(chunks)).astype(np.int64)
        facts[:, 5], facts[:, 6] = self.used + np.concatenate(([0], np.cumsum(per_chunk)[:-1])), per_chunk
        if self.used + len(pair) > self.pool.shape[1]:
            self.pool = np.concatenate((self.pool[:, : self.used], np.zeros((2, max(len(pair), self.used)), np.int64)), axis=1)
        self.pool[:, self.used : self.used + len(pair)] = pair, times
        self.used += len(pair)
        # groups as text
        written = [list(map(names.__getitem__, x.tolist())) for names, x in zip(self.names, ids)]
        edge = [np.concatenate(([0], np.cumsum(n))).tolist() for n in n_ids]
        left, right = ([own[i] if j == i + 1 else ",".join(own[i:j]) for i, j in zip(at, at[1:])] for own, at in zip(written, edge))
        shown = [f"{x}|{y}" for x, y in zip(left, right)]
        at = 0
        for k, n in enumerate(facts[:, 3].tolist()):
            self.texts.append(";".join(shown[at : at + n]))
            at += n
        for k, chunk in enumerate(chunks):
            self.memo[chunk] = base + k

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of UTF-8: (a row of n_a, n_b, n_groups, n_links for each, its groups as text, and its links: number of the
        row, pair, how often it occurs; each pair of a row once)."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        # a blank before each text that is not empty
        own = np.insert(data[offsets[0] : offsets[-1]], offsets[:-1][full] - offsets[0], 0x20)
        ends = np.concatenate(([0], np.cumsum(sizes[full] + 1)))
        starts = self.chunks(own, ends)
        raw, edges = own.tobytes(), [*starts.tolist(), len(own)]
        chunks = [raw[i:j] for i, j in zip(edges, edges[1:])]
        if len(self.memo) > REMEMBERED:
            self.forget()
        if new := list({c: None for c in chunks if c not in self.memo}):
            self._learn(new)
        slot = np.fromiter(map(self.memo.__getitem__, chunks), np.int64, len(chunks))
        bounds = np.searchsorted(starts, ends)
        facts = self.facts[slot]
        sums = np.zeros((n, 4), np.int64)
        texts = [""] * n
        good = np.zeros(n, bool)
        if len(full):
            good[full] = np.minimum.reduceat(facts[:, 0], bounds[:-1]) > 0
            sums[full] = np.add.reduceat(facts[:, 1:5], bounds[:-1], axis=0)
            sums[~good] = 0
            for k, row in enumerate(full.tolist()):
                if good[row]:
                    texts[row] = ";".join([self.texts[s] for s in slot[bounds[k] : bounds[k + 1]].tolist()])
        row_of = np.repeat(full, np.diff(bounds))
        keep = good[row_of]
        # a row's chunks once each, then their pairs
        key, times = _summed(row_of[keep] * len(self.texts) + slot[keep], np.ones(int(keep.sum()), np.int64))
        row, slot = key // max(len(self.texts), 1), key % max(len(self.texts), 1)
        at, many = self.facts[slot, 5], self.facts[slot, 6]
        out_keys, out_times = [], []
        edges = np.concatenate(([0], np.cumsum(many)))
        i = 0
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + EXPANDED, "right")) - 1)
            place = _ranges(at[i:j], many[i:j])
            k, v = _summed(self.pool[0, place] * n + np.repeat(row[i:j], many[i:j]), self.pool[1, place] * np.repeat(times[i:j], many[i:j]))
            out_keys.append(k)
            out_times.append(v)
            i = j
        key, times = _summed(np.concatenate([np.zeros(0, np.int64), *out_keys]), np.concatenate([np.zeros(0, np.int64), *out_times]))
        return sums, texts, key % max(n, 1), key // max(n, 1), times


# Packed rows -----------------------------------------------------------------------------------------------------------
#: docs: what is known of a run's documents. links: a stripe's links of a run. sums: documents of pairs in a stripe.
LINKS = "kind string, run bigint, stripe int, doc array<bigint>, facts array<bigint>, sha array<string>, payload array<binary>"
_NAMES = ["kind", "run", "stripe", "doc", "facts", "sha", "payload"]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary())]


def _pack(x: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the greatest needs, which the first byte says."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _by_stripe(pair: np.ndarray, width: int, stripes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by stripe and pair, bounds of stripes in that order, key of the pair in its stripe)."""
    first = pair // width
    stripe, key = first % stripes, first // stripes * width + pair % width
    order = np.lexsort((key, stripe))
    return order, np.searchsorted(stripe[order], np.arange(stripes + 1)), key[order]


def _encode(first, other, stripes: int, run_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner.load(first, other)
    width = aligner.widths[1]
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def passed() -> pa.RecordBatch | None:
        pair, n = _summed(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        order, bounds, key = _by_stripe(pair, width, stripes)
        rows = [("sums", None, s, None, None, None, [_pack(key[i:j]), _pack(n[order[i:j]])]) for s, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        return _batch(rows) if rows else None

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        docs = batch.column(0).to_pylist()
        for i, j in runs(offsets, run_bytes):
            facts, texts, doc, pair, times = aligner.align(data, offsets[i : j + 1])
            sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            rows = [("docs", number, -1, docs[i:j], facts.ravel().tolist(), sha, None)]
            order, bounds, key = _by_stripe(pair, width, stripes)
            doc, times = doc[order], times[order]
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[s], bounds[s + 1]
                at = np.flatnonzero(np.concatenate(([True], key[a + 1 : b] != key[a : b - 1])))
                rows.append(("links", number, s, None, None, None, [_pack(key[a:b][at]), _pack(np.diff(np.append(at, b - a))), _pack(doc[a:b]), _pack(times[a:b])]))
            yield _batch(rows)
            at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
            held.append((pair[at], np.diff(np.append(at, len(pair)))))
            if sum(len(p) for p, _ in held) > HELD:
                merged = _summed(*(np.concatenate(x) for x in zip(*held)))
                held[:] = [merged]
                if len(merged[0]) > HELD // 2 and (out := passed()) is not None:
                    yield out
            number += 1
    if (out := passed()) is not None:
        yield out


class _Block:
    """A stripe's dense matrix: in how many documents each of its ids is linked with each of the other side's. Rows that
    nothing was added to are not read."""

    def __init__(self, rows: int, width: int):
        self.n, self.used, self._best = np.zeros((rows, width), np.int64), np.zeros(rows, bool), None

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        row = key // self.n.shape[1]
        np.add.at(self.n, (row, key % self.n.shape[1]), n)
        self.used[row] = True
        self._best = None

    def best(self) -> np.ndarray:
        """The highest count of each row."""
        if self._best is None:
            self._best = np.zeros(len(self.n), np.int64)
            self._best[self.used] = self.n[self.used].max(axis=1)
        return self._best

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of all linked pairs."""
        rows = np.flatnonzero(self.used)
        a, b = np.nonzero(self.n[rows])
        return rows[a] * self.n.shape[1] + b, self.n[rows[a], b]


def _count(widths: tuple[int, int], stripes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums, ordered by stripe, to each stripe's counts: (stripe, [pairs, counts])."""
    rows, width = -(-widths[0] // stripes), widths[1]
    now, block = None, None

    def out() -> Iterator[pa.RecordBatch]:
        key, n = block.pairs()
        for i in range(0, len(key), PASSED):
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([[_pack(key[i : i + PASSED]), _pack(n[i : i + PASSED])]], pa.list_(pa.binary()))], names=["stripe", "payload"])

    for batch in batches:
        for stripe, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if stripe != now:
                if block is not None:
                    yield from out()
                now, block = stripe, _Block(rows, width)
            block.add(*map(_unpack, payload))
    if block is not None:
        yield from out()


def _score(widths: tuple[int, int], stripes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stripe's counts, then its links: for each run the sums of best links and of counts by document."""
    rows, width = -(-widths[0] // stripes), widths[1]
    now, block = None, None
    for batch in batches:
        runs_, out = [], []
        for stripe, part, run, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if (stripe, part) != now:
                now, block = (stripe, part), _Block(rows, width)
            own = [_unpack(p) for p in payload]
            if run is None:
                block.add(*own)
                continue
            key, n, doc, times = own
            count = block.n[key // width, key % width]
            is_best = np.repeat(count == block.best()[key // width], n)
            weighed = np.bincount(doc, times * is_best), np.zeros(doc.max() + 1, np.int64)
            np.add.at(weighed[1], doc, times * np.repeat(count, n))
            runs_.append(run)
            out.append([_pack(weighed[0].astype(np.int64)), _pack(weighed[1])])
        yield pa.RecordBatch.from_arrays([pa.array(runs_, pa.int64()), pa.array(out, pa.list_(pa.binary()))], names=["run", "payload"])


RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run's documents, then its scores by stripe, to a row for each document."""
    held = None

    def out() -> pa.RecordBatch:
        docs, facts, sha, sums = held
        facts = np.array(facts, np.int64).reshape(len(docs), 4)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in facts.T), pa.array(sums[0]), pa.array(sums[1]), pa.array(sha, pa.string())], names=["doc", *RESULT])

    for batch in batches:
        for docs, facts, sha, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if docs is not None:
                if held is not None:
                    yield out()
                held = docs, facts, sha, np.zeros((2, len(docs)), np.int64)
                continue
            for row, data in zip(held[3], payload):
                x = _unpack(data)
                row[: len(x)] += x
    if held is not None:
        yield out()


class Alignment:
    """The links of docs(doc_id, text), packed in the shared folder, and what follows from them.

    first and other are sides: (library, file). Null and empty texts, and those whose ids do not give back their bytes on
    either side, have no tokens. Rows with equal or null ids are documents of their own; other columns are not read. An
    empty table has no links.
    """

    def __init__(self, docs: DataFrame, first: tuple[str, str], other: tuple[str, str], *, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, run_bytes: int = RUN):
        self.spark = docs.sparkSession
        ship(self.spark)
        aligner = Aligner.load(first, other)
        self.widths, self.stripes = tuple(aligner.widths), stripes
        self.scratch = Scratch(self.spark, "align")
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
        self.path = self.scratch.path("links")
        rows.mapInArrow(partial(_encode, first, other, stripes, run_bytes), LINKS).write.partitionBy("kind").option("compression", "zstd").parquet(self.path)
        self._counts: DataFrame | None = None

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(LINKS).parquet(self.path).where(F.col("kind") == kind)

    def counts(self) -> DataFrame:
        """(stripe, payload): in how many documents each pair is linked, packed; computed once."""
        if self._counts is None:
            sums = self._read("sums").select("stripe", "payload").repartition("stripe").sortWithinPartitions("stripe")
            found = sums.mapInArrow(partial(_count, self.widths, self.stripes), "stripe int, payload array<binary>")
            self._counts = self.scratch.table(found, "counts")
        return self._counts

    def pairs(self) -> DataFrame:
        """(a, b, n, is_best): each linked pair of ids, in how many documents, and whether no other pair of a has more."""
        width, stripes = self.widths[1], self.stripes

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    key, n = map(_unpack, payload)
                    yield pa.RecordBatch.from_arrays([pa.array(key // width * stripes + stripe), pa.array(key % width), pa.array(n)], names=["a", "b", "n"])

        found = self.counts().mapInArrow(go, "a bigint, b bigint, n bigint")
        best = found.groupBy("a").agg(F.max("n").alias("most"))
        return found.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))

    def scores(self) -> DataFrame:
        """(doc, *RESULT) of each row of docs: ids of both sides, groups, links, links whose pair's count is the highest of
        its first id, the sum of the links' counts, and the SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3`` ('' without)."""
        links, docs = self._read("links"), self._read("docs")
        n = docs.count()
        parts = max(1, -(-n // SCORED_RUNS))
        split = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        counts = self.counts().select("stripe", split, F.lit(None).cast("bigint").alias("run"), "payload")
        own = links.select("stripe", F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int").alias("part"), "run", "payload")
        both = counts.unionByName(own).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "run")
        scored = both.mapInArrow(partial(_score, self.widths, self.stripes), "run bigint, payload array<binary>")
        none = lambda kind: F.lit(None).cast(kind)
        heads = docs.select("run", F.lit(0).alias("turn"), "doc", "facts", "sha", none("array<binary>").alias("payload"))
        tails = scored.select("run", F.lit(1).alias("turn"), none("array<bigint>").alias("doc"), none("array<bigint>").alias("facts"), none("array<string>").alias("sha"), "payload")
        rows = heads.unionByName(tails).repartition("run").sortWithinPartitions("run", "turn").select("doc", "facts", "sha", "payload")
        kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in RESULT)
        return rows.mapInArrow(_finish, f"doc bigint, {kinds}")
