"""Conversation structure repair by signatures.

Each conversation is encoded as a compact string, one character a row for its role's initial and its fault. Each distinct
string is solved once, by memoised recursion over its halves; the audit (the cheapest edits) is joined back to all
conversations that share it, and replayed on their rows.

Rows of a conversation are in the order of turn (nulls first), role and SHA-256 of the text. Null roles and texts are one
space; rows with a null id are a conversation of their own. The first fault of a row counts: ``blank`` (nothing but white
space), ``duplicate`` (role and text seen earlier), ``truncated`` (the last character that is no white space is none of
``.!?``). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert an
empty user or assistant row anywhere 5; truncated rows that are not deleted add 5. The repaired roles' initials are
``(s?(ua)+)?``; of equally cheap audits the least by ASCII is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm._cluster import Scratch, ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INK = r"[^\x20\x09-\x0D]"
#: Characters of a signature: by initial (system, user, assistant, other), for sound, truncated and deleted rows.
SOUND, CUT, GONE = "suao", "SUAO", "0123"
#: Pieces of signatures up to this length are remembered, so many of them.
REMEMBERED_LENGTH, REMEMBERED = 64, 1 << 14
#: Rows of a fragment, in which a part of a conversation is encoded.
FRAGMENT = 1 << 16

# A state is the initial of the last row so far: 0 none, 1 system, 2 user, 3 assistant.
_AFTER = {0: 2, 1: 2, 3: 2, 2: 3}
_KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
Best = dict[tuple[int, int], tuple[int, str]]


def _inserts(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after no insert and after one or two; more would come back to where they were."""
    one = _AFTER[state]
    two = _AFTER[one]
    return [(state, 0, ""), (one, INSERT, "I"), (two, 2 * INSERT, "II")]


def _row(code: str) -> Best:
    """The best way from each state to each other over one row, inserts before it included."""
    best: Best = {}
    for before in range(4):
        for state, cost, letters in _inserts(before):
            ways = [(state, DELETE, "D")]
            if code != "x":
                extra = TRUNCATED * code.isupper()
                ways += [(after, KEEP + extra, "K") for at, after in _KEEPS[code.lower()].items() if at == state]
                ways.append((_AFTER[state], REROLE + extra, "R"))
            for after, more, letter in ways:
                found = (cost + more, letters + letter)
                best[before, after] = min(best.get((before, after), found), found)
    return best


def _joined(left: Best, right: Best) -> Best:
    """Two audits of the same rows at the same cost are never each other's beginning, so the least audits of the parts
    give the least of the whole."""
    best: Best = {}
    for (a, b), (cost, letters) in left.items():
        for c in range(4):
            if (b, c) in right:
                found = (cost + right[b, c][0], letters + right[b, c][1])
                best[a, c] = min(best.get((a, c), found), found)
    return best


def _solved(piece: str) -> Best:
    return _remembered(piece) if len(piece) <= REMEMBERED_LENGTH else _halves(piece)


def _halves(piece: str) -> Best:
    if len(piece) == 1:
        return _row(piece)
    middle = 1 << (len(piece) - 1).bit_length() - 1
    return _joined(_solved(piece[:middle]), _solved(piece[middle:]))


_remembered = lru_cache(REMEMBERED)(_halves)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature: a character of suao for each sound row, of SUAO for each truncated one, and x for each
    that must be deleted. The recursion is as deep as the logarithm of its length."""
    ways = {(0, 0): (0, "")} if not signature else _solved(signature)
    ends = [(cost + more, letters + last) for (start, state), (cost, letters) in ways.items() if start == 0 for after, more, last in _inserts(state) if after in (0, 3)]
    return min(ends)


def damage(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): rows damaged by the CRC of ``conv:turn`` modulo 20: 0 drops a row (times is 0), 1
    empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it (times is 2), 4 makes it the
    user's. Nulls in the key, roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col))) % 20
    own = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return own.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def _rows(turns: DataFrame) -> DataFrame:
    """turns with defaults for nulls and a digest of the text."""
    text = F.coalesce("text", F.lit(" "))
    times = F.col("times").cast("bigint") if "times" in turns.columns else F.lit(1).cast("bigint")
    return turns.select("conv", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), times.alias("times"))


def _marked(turns: DataFrame) -> DataFrame:
    """A row for all equal rows of a turn: conv, turn, role, digest, codes (a character for each), and their faults."""
    class_of = lambda chars: F.translate(F.col("initial"), "suao", chars)
    initial = F.substring("role", 1, 1)
    rows = _rows(turns).select(
        "conv", "turn", "role", "digest", "times", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.col("text").rlike(INK)).alias("blank"), F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1).alias("last"),
    )
    keys = ["conv", "turn", "role", "digest", "initial", "blank", "last"]
    own = rows.groupBy(*keys).agg(F.sum("times").alias("n"))
    seen = Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    fresh = ~F.col("blank") & (F.coalesce(F.sum("n").over(seen), F.lit(0)) == 0) & (F.col("n") > 0)
    own = own.withColumn("fresh", fresh).withColumn("cut", F.col("fresh") & ~F.col("last").isin(".", "!", "?"))
    gone = F.when(F.col("fresh"), F.col("n") - 1).otherwise(F.col("n"))
    codes = F.concat(F.when(F.col("cut"), class_of(CUT)).when(F.col("fresh"), class_of(SOUND)).otherwise(""), F.repeat(class_of(GONE), gone.cast("int")))
    return own.select("conv", "turn", "role", "digest", codes.alias("codes"), F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).otherwise(gone).alias("duplicate"), F.col("cut").cast("bigint").alias("truncated"))


_FRAGMENT = "turn bigint, role string, digest binary, low bigint, high bigint, turns bigint, codes string, blank bigint, duplicate bigint, truncated bigint"


def _fragments(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows to fragments of conversations: the first row's key, the range and number of turns, and the codes."""
    own: list = []
    key = codes = None
    names = ["conv", "turn", "role", "digest", "low", "high", "turns", "codes", "blank", "duplicate", "truncated"]

    def flush() -> pa.RecordBatch:
        out, kinds = [list(c) for c in zip(*own)], [kind, pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 3]
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def close() -> None:
        own.append((*key, low, high, n, "".join(codes), *faults))

    for batch in batches:
        for conv, turn, role, digest, code, *found in zip(*(c.to_pylist() for c in batch.columns)):
            if key is None or key[0] != conv or len(codes) >= FRAGMENT:
                if key is not None:
                    close()
                    if len(own) >= 1000:
                        yield flush()
                key, codes, low, high, n, faults = (conv, turn, role, digest), [], None, None, 0, [0, 0, 0]
            codes.append(code)
            faults = [a + b for a, b in zip(faults, found)]
            if code and turn is not None and turn != high:
                low, high, n = turn if low is None else low, turn, n + 1
    if key is not None:
        close()
        yield flush()


def _encode(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation: conv, codes, gaps, blank, duplicate, truncated."""
    order = ["conv", "turn", "role", "digest"]
    marked = _marked(turns)
    kind = marked.schema["conv"].dataType
    pieces = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_fragments, to_arrow_type(kind)), f"conv {kind.simpleString()}, {_FRAGMENT}")
    part = F.struct("turn", "role", "digest", "low", "high", "turns", "codes")
    own = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("parts"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    # a turn that ends a fragment and begins the next one counts once
    start = F.struct(F.lit(None).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("n"))
    add = lambda s, f: F.struct(F.coalesce(f["high"], s["high"]).alias("high"), (s["n"] + f["turns"] - F.when(f["low"] == s["high"], 1).otherwise(0)).alias("n"))
    distinct = F.aggregate("parts", start, add)["n"]
    span = F.array_max("parts.high").cast("decimal(20,0)") - F.array_min("parts.low").cast("decimal(20,0)") + 1 - distinct
    own = own.select("conv", F.array_join("parts.codes", "").alias("codes"), F.coalesce(span.try_cast("bigint"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated")
    return scratch.table(own, "conversations")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def audits(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of turns(conv, turn, role, text).

    A column times says how often each row counts, if there is one; conversations whose rows all count 0 times, and only
    they, have an empty audit without any edit. gaps are turns missing between the least and the greatest, nulls ignored,
    0 without any (null if they do not fit); illegal counts adjacent roles whose initials are none of su, ua, au. An empty
    table gives no rows; other columns are not read.

    Rows are dealt by ranges of (conv, turn, role, digest), without their texts, so a conversation of any length is
    encoded by many tasks; only its string, a byte a row, comes together.
    """
    spark = turns.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repair")
    found = _encode(turns, scratch).withColumn("signature", F.translate("codes", GONE, "xxxx"))
    solved = found.select("signature").distinct().mapInArrow(_solve, "signature string, cost bigint, audit string")
    roles = F.translate("codes", CUT + GONE, SOUND + SOUND)
    illegal = F.greatest(F.length("codes") - 1, F.lit(0)) - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    return found.join(solved, "signature").select("conv", "gaps", "blank", "duplicate", "truncated", illegal.cast("bigint").alias("illegal"), "cost", "audit")


class _Replay:
    """The rows of one conversation, edited one after the other: (edit, role, text) of each that stays or comes in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "user"

    def _new(self) -> str:
        role, self.next = self.next, "assistant" if self.next == "user" else "user"
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield "R", self._new(), text
        elif edit == "K":
            self.next = "assistant" if role[:1] == "u" else "user"
            yield "K", role, text


def _replay(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order; all in one partition, which reads them as a stream."""
    rows = _rows(turns).where("times > 0").withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text", "times")), "audit")
    both = heads.unionByName(rows).withColumn("is_row", F.col("audit").isNull())
    return both.repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "role", "digest").select("conv", "role", "text", "times", "audit")


def _played(batches: Iterator[pa.RecordBatch], begin: Callable, edit: Callable, end: Callable, out: list, kinds: dict) -> Iterator[pa.RecordBatch]:
    """Call begin(conv), edit(edit, role, text) and end() in order; what they append to out leaves after each batch."""
    replay = None

    def close() -> None:
        if replay is not None:
            for e in replay.inserted():
                edit(*e)
            end()

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    for batch in batches:
        for conv, role, text, times, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                close()
                replay = _Replay(audit)
                begin(conv)
            for _ in range(times or 0):
                for e in replay.row(role, text):
                    edit(*e)
        yield flushed()
    close()
    yield flushed()


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of each conversation after its audit of ``found``, as audits() gives it for
    the same turns; place counts from 0. Edits are K, R and I; deleted rows are not there."""
    ship(turns.sparkSession)
    rows = _replay(turns, found)
    kinds = {"conv": to_arrow_type(rows.schema["conv"].dataType), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        at = [None, 0]

        def begin(conv):
            at[:] = conv, 0

        def edit(letter, role, text):
            out.append((*at, letter, role, text))
            at[1] += 1

        return _played(batches, begin, edit, lambda: None, out, kinds)

    return rows.mapInArrow(go, f"conv {rows.schema['conv'].dataType.simpleString()}, place bigint, edit string, role string, text string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the SHA-256 of the repaired rows as ``role:text``, joined by line feeds; that of nothing where
    none is left. It runs over a conversation from its first to its last row, so one task reads these, as a stream."""
    ship(turns.sparkSession)
    rows = _replay(turns, found)
    kinds = {"conv": to_arrow_type(rows.schema["conv"].dataType), "repaired_sha256": pa.string()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        now: list = []

        def begin(conv):
            now[:] = conv, hashlib.sha256(), ""

        def edit(_, role, text):
            now[1].update(f"{now[2]}{role}:{text}".encode())
            now[2] = "\n"

        return _played(batches, begin, edit, lambda: out.append((now[0], now[1].hexdigest())), out, kinds)

    return rows.mapInArrow(go, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """audits() with repaired_sha256, one row a conversation. Audits are written in the shared folder between."""
    found = Scratch(turns.sparkSession, "audits").table(audits(turns), "audits")
    hashed = digests(turns, found).withColumnRenamed("conv", "own")
    return found.join(hashed, found["conv"].eqNullSafe(hashed["own"])).drop("own")
