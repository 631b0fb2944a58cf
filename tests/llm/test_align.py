import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import align, queries
from quillon.llm._text import utf8

SIDES = ("tokenizers", public_tokenizers.path("byte_bpe_50k.json")), ("sentencepiece", public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "two words", "line\nline two\n\nthree", "<|endoftext|> x <s>y</s> <unk> <0x41>", "été, ça <b>où</b>", "漢字かな 交じり。　文", "\U0001f600\U0001f468‍\U0001f469 ok",
    "▁ piece sign", "x▁y plain", "nul\x00byte", "tab\tand\x0bvt \x1f us", "nbsp  here", "nel\u0085 x", "ogham  x", "  em", "é combined", "1234567 8 9,10", "don't we'll", "aaaa" * 50, "   indented\n    more", "word " * 40,
    "trailing   ", "ﬁ ligature Ａ wide", "Привет, мир", "...!!! ??? ---", "a\r\nb \r c",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(SIDES[0][1])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SIDES[1][1])


PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
TABLE = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def unsigned(token):
    """Bytes of an entry of a byte-level vocabulary."""
    return bytes(TABLE[c] for c in token)


def groups_of(text, a, b):
    """[(ids of a, ids of b)] of each group, of the whole text; None if the bytes differ."""
    if not text:
        return None
    want = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [unsigned(a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(p) != want for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]) for p in parts]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    group = [np.searchsorted(cuts, e) for e in ends]
    out = [([], []) for _ in cuts]
    for side in (0, 1):
        for i, g in zip(ids[side], group[side].tolist()):
            out[g][side].append(i)
    return out


def plain(rows, libraries):
    """Results of (doc, text) rows by whole texts and all links, as a sorted list."""
    found = [(doc, groups_of(text, *libraries)) for doc, text in rows]
    links = [Counter((x, y) for g in groups or () for x in g[0] for y in g[1]) for _, groups in found]
    count = Counter(p for own in links for p in own)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, groups), own in zip(found, links):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups or ())
        sizes = [sum(len(g[k]) for g in groups or ()) for k in (0, 1)]
        out.append((doc, *sizes, len(groups or ()), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return sorted(out, key=repr), count, best


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("doc", *align.RESULT)) for r in frame.collect()), key=repr)


def test_odd_texts(spark, libraries):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "two words"), (3, "two words"), (1000, "long " * 30_000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kind string, run int").repartition(3)
    want, count, best = plain(rows, libraries)
    found = align.Alignment(frame, *SIDES)
    assert rows_of(found.scores()) == want
    assert {(r.a, r.b): (r.n, r.is_best) for r in found.pairs().collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


@pytest.mark.parametrize("limits", [{"EXPANDED": 3, "REMEMBERED": 5, "HELD": 20, "PASSED": 4, "SCORED_RUNS": 2}])
def test_small_limits_change_nothing(spark, libraries, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(align, name, value)
    rows = [(k, t) for k, t in enumerate(ODD * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(align.Alignment(frame, *SIDES, stripes=7, run_bytes=40).scores()) == plain(rows, libraries)[0]


def test_limits_within_a_task(libraries, monkeypatch):
    monkeypatch.setattr(align, "EXPANDED", 2)
    monkeypatch.setattr(align, "REMEMBERED", 3)
    aligner = align.Aligner(*SIDES)
    for texts in (ODD, ODD[::-1], ODD[:9]):
        facts, shown, doc, pair, times = aligner.align(*utf8(pa.array(texts, pa.string())))
        for k, text in enumerate(texts):
            groups = groups_of(text, *libraries) or []
            assert shown[k] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), text
            assert facts[k].tolist() == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(len(g[0]) * len(g[1]) for g in groups)]
            want = Counter(x * aligner.widths[1] + y for g in groups for x in g[0] for y in g[1])
            assert dict(zip(pair[doc == k].tolist(), times[doc == k].tolist())) == want


def test_packing():
    for x in ([], [0], [255, 256], [2**32], [7] * 5):
        assert align._unpack(align._pack(np.array(x, np.int64))).tolist() == x


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    found = align.Alignment(frame, *SIDES)
    assert found.scores().collect() == [] and found.pairs().collect() == []


def test_registered_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op13_alignment(spark, folder)
    assert rows_of(got.withColumnRenamed("doc_id", "doc")) == plain(rows, libraries)[0]
