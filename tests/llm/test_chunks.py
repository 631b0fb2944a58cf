import hashlib
import random
import re

from quillon.llm import chunks

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute_force(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), k))
    out = set()
    for plain, own in groups.items():
        keep = min(own)[1]
        out |= {(k, keep, len(own), k == keep, hashlib.sha256(plain.encode()).hexdigest()) for _, k in own}
    return out


def test_duplicates_match_brute_force(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdé \n") for _ in range(100_000))
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "ab ", " ab", "漢 字", "漢字", long, long.replace("a", " a"), long[:-1], long[:50_000] + "!" + long[50_000:], "x" * 40_000, "x" * 40_001, "x " * 40_000]
    rows = list(enumerate(texts * 2))
    r.shuffle(rows)
    frame = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, recipe string").repartition(4)
    got = chunks.duplicates(frame)
    assert {tuple(x)[:5] for x in got.collect()} == brute_force(rows)
    assert sorted(x.doc_id for x in chunks.drop_duplicates(frame).collect()) == sorted(k for k, keep, *_ in brute_force(rows) if k == keep)


def test_shared_passages_share_chunks(spark):
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh") for _ in range(60_000))
    frame = spark.createDataFrame([(1, "one" * 500 + passage), (2, passage + "two" * 700)], "doc_id long, text string")
    found = chunks.recipes(frame)
    shared = chunks.uses(found).where("uses > 1").select("identifier")
    got = {x.identifier: x.content for x in chunks.contents(frame, shared).collect()}
    assert len(got) > 10 and all(x.decode() in passage for x in got.values())
    assert got.keys() >= {x.identifier for x in shared.collect()}
    assert max(map(len, got.values())) <= chunks.MOST


def test_identifiers_of_one_byte_are_made_longer_until_they_tell_chunks_apart(spark):
    rows = [(k, f"text number {k % 700}") for k in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.duplicates(frame, size=1)
    assert {tuple(x)[:5] for x in got.collect()} == brute_force(rows)


def test_the_filter_follows_the_number_of_identifiers():
    assert [chunks.filter_bits(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 24, 1 << 40)] == [26, 26, 26, 27, 28, 29]


def test_a_full_filter_moves_more_and_finds_the_same(spark, monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(9_000)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:20])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    shared = chunks.uses(chunks.recipes(frame)).where("uses > 1").select("identifier")
    narrow = chunks.contents(frame, shared).select("identifier").distinct().count()
    monkeypatch.setattr(chunks, "LEAST_BITS", 4)
    monkeypatch.setattr(chunks, "MOST_BITS", 4)
    assert chunks.contents(frame, shared).select("identifier").distinct().count() > narrow == shared.count()
    assert {tuple(x)[:5] for x in chunks.duplicates(frame).collect()} == brute_force(rows)


def test_row_that_stays_with_repeated_and_null_ids(spark):
    rows = [(None, "same", 1), (5, "same", 2), (5, "other text", 3), (5, "other text", 4), (None, "alone", 5), (7, None, 6), (8, " ", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, recipe int")
    left = sorted(x.recipe for x in chunks.drop_duplicates(frame).collect())
    assert left in ([2, 3, 5, 7], [2, 4, 5, 7])
    assert chunks.drop_duplicates(frame).columns == frame.columns


def test_null_ids_and_empty_table(spark):
    rows = [(None, "same"), (5, "same"), (None, "alone"), (None, None)]
    got = {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in chunks.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)}
    assert chunks.duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
