"""The registered queries themselves, over the whole smallest tables, by brute force or held-out accuracy."""

import html
import math
import re
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from quillon.llm import decontaminate, queries
from tests.llm.test_decontaminate import smith_waterman

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{DATA}/{name}.parquet").collect() for name in ("documents", "pages", "benchmark", "labels")}


@pytest.fixture(scope="module")
def encoded(tables):
    library = Tokenizer.from_file(queries.tokenizer_path())
    return {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in tables["documents"]}


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_op2(spark, encoded):
    rows = queries.op2_token_counts(spark, DATA).collect()
    lengths = [len(x) for x in encoded.values()]
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in lengths}
    for r in rows:
        assert (r.docs_longer, r.tokens_longer) == (sum(n > r.n_tokens for n in lengths), sum(n for n in lengths if n > r.n_tokens))
        assert (r.total_docs, r.total_tokens, r.truncated_total) == (len(lengths), sum(lengths), sum(min(n, r.n_tokens) for n in lengths))


def test_op3(spark, tables):
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in queries.op3_decontaminate(spark, DATA).collect()}
    split = re.compile(r"[^\W_]+").findall
    items = [(r.item_id, split(r.text.lower())) for r in tables["benchmark"]]
    want = {}
    for d in tables["documents"]:
        own = split((d.text or "").lower())
        for k, item in items:
            if len(set(item) & set(own)) * 2 >= len(set(item)) and (score := smith_waterman(item, own) / (decontaminate.MATCH * len(item))) >= decontaminate.LIMIT:
                want[d.doc_id, k] = round(score, 9)
    assert got == want


def test_op4(spark, tables):
    got = {r.doc_id: r for r in queries.op4_language_id(spark, DATA).collect()}
    assert len(got) == len(tables["documents"]) and {type(r.score) for r in got.values()} == {float}
    held = []
    for d in tables["documents"]:
        r = got[d.doc_id]
        assert r.held_out == (crc(d.doc_id) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and d.lang is not None and r.lang_pred != "und":
            held.append(r.lang_pred == d.lang)
    assert held and sum(held) / len(held) >= 0.95


def test_null_ids_are_not_held_out(spark):
    docs = spark.createDataFrame([(None,), (1,)], "doc long")
    for parts, remainder in ((4, 2), (3, 1)):
        got = docs.select("doc", queries.held_out("doc", parts, remainder)).collect()
        assert {r.doc: r.held_out for r in got} == {None: False, 1: crc(1) % parts == remainder}


def test_op7(spark, encoded):
    want, start = [], 0
    for k, ids in sorted(encoded.items()):
        own = [*ids, 2]
        want.append((k, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
        start += len(own)
    assert sorted(map(tuple, queries.op7_token_files(spark, DATA).collect())) == want


def test_op8(spark, tables):
    got = {r.doc_id: r for r in queries.op8_quality(spark, DATA).collect()}
    assert len(got) == len(tables["documents"]) and all(r.held_out == (crc(k) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and math.isfinite(r.score) for k, r in got.items())
    held = [got[r.doc_id].predicted == r.quality for r in tables["labels"] if r.quality is not None and r.doc_id in got and got[r.doc_id].held_out]
    assert held and sum(held) / len(held) >= 0.8


def test_op10(spark, tables):
    got = {r.page_id: r for r in queries.op10_html_text(spark, DATA).collect()}
    for p in tables["pages"]:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        text = " ".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", inner)) if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)
