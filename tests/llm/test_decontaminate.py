import random
import re

import numpy as np

from quillon.llm import decontaminate as d


def smith_waterman(item, text):
    best, h = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a == b else -d.MISMATCH), h[i - 1][j] - d.GAP, h[i][j - 1] - d.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_recurrence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 12))] for _ in range(2))
        score, end = d.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[:end]) == score


def corpus():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [words(r.randrange(12, 40)) for _ in range(12)]
    docs = []
    for i in range(120):
        own = words(r.choice((0, 3, 40, 200)))
        if i % 3 == 0:
            copy = list(items[i % len(items)])
            for _ in range(len(copy) * (i % 5) // 20):
                k = r.randrange(len(copy))
                if r.random() < 0.5:
                    copy[k] = r.choice(vocabulary)
                else:
                    del copy[k]
            at = r.randrange(len(own) + 1)
            own[at:at] = copy
        text = " ".join(own)
        docs.append((i, text.upper().replace(" ", " ,\n") if i % 4 == 0 else text))
    return docs, [(100 + k, " ".join(x)) for k, x in enumerate(items)]


def test_matches_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in docs] + [(500, None, "x"), (501, "", "x"), (None, items[0][1], "x")], "doc_id long, text string, score string").repartition(3)
    bench = spark.createDataFrame(items + [(900, None), (901, "too short")], "item_id long, text string")
    split = re.compile("[a-z0-9]+").findall
    want = {}
    for k, t in docs + [(None, items[0][1])]:
        for i, x in items:
            a, b = split(x.lower()), split(t.lower())
            score = smith_waterman(a, b) / (d.MATCH * len(a))
            if score >= d.LIMIT:
                want[(k, i)] = round(score, 9)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(frame, bench).collect()}
    assert len(want) > 30 and got == want
    blocks = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(frame, bench, block_chars=400).collect()}
    assert blocks == want
    left = [r.doc_id for r in d.drop_contaminated(frame, bench).collect()]
    assert sorted(x for x in left if x is not None) == sorted({k for k, _ in docs} - {k for k, _ in want}) + [500, 501] and None in left


def test_spans_and_accents(spark):
    item = "Él Ñandú corrió por la pampa húmeda hasta llegar al río"
    text = "Antes: " + item.upper() + "! Después."
    row = d.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(None, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in row] == [(1, None, 1.0)]
    assert text.encode()[row[0].first_byte : row[0].end_byte].decode() == item.upper()


def edited(item, rate, r):
    """A copy with this share of its words replaced, removed or preceded by another."""
    out = []
    for w in item:
        kind = r.randrange(3) if r.random() < rate else 3
        out += [[f"x{r.randrange(10**6)}"], [], [f"x{r.randrange(10**6)}", w], [w]][kind]
    return out


def test_recall_of_edited_copies_over_rates():
    """Against alignment of every pair, with and without exact copies and common n-grams elsewhere."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "and", "to"] * 300
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (12, 20, 42, 60) for _ in range(8)]
    rates = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35)
    copies = [(k, rate, edited(item, rate, r)) for rate in rates for k, item in enumerate(items)]
    index = d.build_index([(k, " ".join(x)) for k, x in enumerate(items)], d.SEED_WORDS, d.LEAST_WORDS)
    numbers = lambda xs: d.words(*d.utf8(d.pa.array([" ".join(xs)], d.pa.large_string())))[2]
    own = [numbers(x) for _, _, x in copies]
    for extra in (0, 5_000):
        counts = np.zeros(len(index.keys), np.int64)
        for words in own:
            at, key = d._hits(index, d.shingles(words, d.SEED_WORDS))
            counts[np.unique(key)] += 1
        counts += extra  # exact copies of all items in so many other documents
        seeds = d.seeds_only(index, counts, d.SEED_SHARE, d.COMMON)
        hit, there = dict.fromkeys(rates, 0), dict.fromkeys(rates, 0)
        for (k, rate, x), words in zip(copies, own):
            if smith_waterman(items[k], x) >= d.LIMIT * d.MATCH * len(items[k]):
                there[rate] += 1
                hit[rate] += k in {n for n, *_ in d.passages(seeds, words, d.SEED_WORDS, d.LIMIT)}
        recall = {rate: round(hit[rate] / there[rate], 3) for rate in rates if there[rate]}
        print(extra, recall, sum(there.values()))
        assert min(recall.values()) >= 0.9 and sum(hit.values()) >= 0.97 * sum(there.values())


def test_seeds_are_those_that_occur(spark):
    """Six of forty n-grams are shared: two words in seven are replaced."""
    item = [f"w{i}" for i in range(42)]
    copy = [w if i % 7 not in (2, 6) else f"other{i}" for i, w in enumerate(item)]
    found = d.find(spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string"), spark.createDataFrame([(-1, " ".join(item)), (None, "w1 w2 w3")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, -1)] and found[0].score >= d.LIMIT


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert d.find(docs.limit(0), items).collect() == [] == d.find(docs, items.limit(0)).collect()


def test_a_passage_in_every_document_is_found(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(k, t.lower() + " " + items[0][1]) for k, t in docs], "doc_id long, text string")
    assert d.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).where("item_id = 100").count() == len(docs)


def test_short_items_are_found_word_for_word(spark):
    docs = [(1, "so: Name, the Capital of FRANCE! name the capital of France"), (2, "name the capital of Spain"), (3, "of France"), (4, ""), (5, "France name the capital of"), (6, None), (7, "x y"), (8, "x y")]
    items = [(10, "Name the capital of France?"), (11, "of france"), (12, "x"), (None, "x y"), (13, "?!"), (14, "y x")]
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id, str(r.item_id), r.score, dict(docs)[r.doc_id].encode()[r.first_byte : r.end_byte].decode().lower()) for r in found)
    copies = ["name the capital of france", "name, the capital of france"]
    assert got == sorted([(1, "10", 1.0, c) for c in copies] + [(1, "11", 1.0, "of france")] * 2 + [(3, "11", 1.0, "of france")] + [x for k in (7, 8) for x in ((k, "12", 1.0, "x"), (k, "None", 1.0, "x y"))])


def test_scripts_without_blanks(spark):
    items = [(1, "下列哪一项最能说明光合作用在植物生长过程中的重要性？请选择正确的答案，并说明理由。"), (2, "ข้อใดต่อไปนี้อธิบายการสังเคราะห์แสงของพืชได้ดีที่สุด"), (3, "東京はどこですか。")]
    texts = [f"前文。{items[0][1].replace('最能', '能够')}后文", f"ก่อนหน้า{items[1][1]}หลังจาก", "問い：東京はどこですか？", "这是一篇关于天气的文章，与考试没有任何关系。", "before " + items[0][1] + " after"]
    found = d.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.score, texts[r.doc_id].encode()[r.first_byte : r.end_byte].decode()) for r in found}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (4, 1)} and len(found) == 4
    assert got[1, 2] == (1.0, items[1][1]) and got[2, 3] == (1.0, "東京はどこですか") and got[4, 1] == (1.0, items[0][1][:-1]) and 0.8 < got[0, 1][0] < 1


def test_each_copy_of_an_item_is_a_passage(spark):
    item = "which of these ten words stands first in the list"
    texts = [" ".join([item] * 5), f"{item} and then {item} x {item.replace('ten ', '')}", item]
    frame, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.first_byte, r.end_byte) for r in d.find(frame, bench).collect())
    step, last = len(item) + 1, len(item) * 2 + 13
    assert found == [(0, k * step, k * step + step - 1) for k in range(5)] + [(1, 0, len(item)), (1, len(item) + 10, last - 3), (1, last, len(texts[1])), (2, 0, len(item))]
    assert {r.doc_id: r.passages for r in d.contaminated(frame, bench).collect()} == {0: 5, 1: 3, 2: 1}
