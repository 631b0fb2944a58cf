import random
import struct
import zlib

import numpy as np
import pytest

from quillon.llm import tokens, wavelet

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def awkward_texts(seed=1, n=400):
    r = random.Random(seed)
    atoms = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "᠎", " ", "don't", "'s", "12", "é", "ß", "Ġ", "Ċ", "漢字", "!!", "###", "<|endoftext|>", "x" * 80, "a", "Ü", "÷", "×", "_", "-", "''", "'re", "endoftext", "|>", "...", "​", "á", "🙂"]
    return ["".join(r.choice(atoms) for _ in range(r.randrange(30))) for _ in range(n)]


def test_remembered_pieces_give_the_library_ids():
    texts = [*awkward_texts(), "", " ", "word " * 1000]
    encoder = tokens.Encoder(PATH)
    assert encoder.cuttable
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    texts = awkward_texts(2, 60)
    encoder = tokens.Encoder(PATH)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == want


def test_files_that_split_otherwise_go_to_the_library_whole():
    encoder = tokens.Encoder(P.path("word_bpe_49k.json"))
    assert not encoder.cuttable
    assert len(encoder.encode(["some words here"])[0]) > 0


def test_histogram_matches_brute_force(spark):
    lengths = [random.Random(3).randrange(20_000) for _ in range(500)] + [0, 0, 7, 7, 7]
    frame = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long")
    hist = tokens.length_histogram(frame)
    rows = hist.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r.total_docs, r.total_tokens, r.truncated_total) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in tokens.limits(hist, [1, 512, 10**6]).collect():
        assert (r.total_tokens, r.truncated_total, r.docs_cut) == (sum(lengths), sum(min(x, r.context_limit) for x in lengths), sum(x > r.context_limit for x in lengths))
    for r in tokens.quantiles(hist, [0.5, 1.0]).collect():
        assert sum(x <= r.n_tokens for x in lengths) / len(lengths) >= r.share


def test_empty_histogram(spark):
    hist = tokens.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert hist.collect() == []
    assert [tuple(r) for r in tokens.limits(hist, [5]).collect()] == [(5, 0, 0, 0)]


def test_token_lengths(spark):
    texts = [None, "", *awkward_texts(4, 50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc: r.n_tokens for r in tokens.token_lengths(frame, PATH).collect()}
    assert got == {i: len(library().encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_matrix_round_trip_and_queries(n):
    r = random.Random(n)
    ids = np.array([min(50_256, int(r.paretovariate(0.6))) for _ in range(n)], "<u2")
    m = wavelet.Matrix(wavelet.build(ids if n % 2 else ids.astype("<u4")))
    assert (m.access(np.arange(n)) == ids).all() and m.n == n
    plain = ids.tolist()
    for i in r.sample(range(n), min(n, 40)):
        assert m.access([i, i]).tolist() == [plain[i]] * 2
        assert m.count(plain[i], i) == plain[:i].count(plain[i])
        places = [k for k, x in enumerate(plain) if x == plain[i]]
        k = r.randrange(len(places))
        assert m.locate(plain[i], k) == places[k]
        assert m.locate(plain[i], len(places)) == -1
    assert m.count(60_000) == 0 and m.locate(60_000, 0) == -1 and m.count(1 << 20) == 0


def test_files_match_brute_force(spark, monkeypatch):
    texts = [None, "", "the same", "the same", *awkward_texts(5, 60), "long text " * 5000]
    rows = [(i * 3 - 20, t, "k") for i, t in enumerate(texts)] + [(5, "a repeated row", "k")] * 2
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = sorted(tuple(r)[:4] for r in wavelet.token_files(frame, PATH, end_id=2).collect())
    want, start = [], 0
    for k, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*library().encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == sorted(want)


def test_shards_are_files_of_whole_documents_and_answer_from_their_planes(spark, tmp_path):
    rows = [(k, " ".join(f"word{(k * j) % 17}" for j in range(k % 60))) for k in range(300)] + [(300, "a long one " * 1_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wavelet.write_shards(frame, f"{tmp_path}/ids", PATH, end_id=2, shard_ids=900)
    shards = sorted(wavelet.read_shards(spark, f"{tmp_path}/ids").collect(), key=lambda r: (r.part, r.shard))
    assert len(shards) > 8 and len(list((tmp_path / "ids").glob("*.parquet"))) >= len(shards)
    encoded = {k: [*library().encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    assert [d for s in shards for d in s.docs] == sorted(encoded)
    token = encoded[59][3]
    found = {(r.part, r.shard): (r.n, r.positions) for r in wavelet.find(spark, f"{tmp_path}/ids", token, most=10**6).collect()}
    for s in shards:
        plain = [x for d in s.docs for x in encoded[d]]
        assert s.n_ids == len(plain) == sum(s.lengths) and (len(s.docs) == 1 or len(plain) <= 900)
        places = [k for k, x in enumerate(plain) if x == token]
        assert found.pop((s.part, s.shard), (0, [])) == (len(places), places)
    assert not found
    got = {r.doc_id: r.ids_crc32 for r in wavelet.documents(spark, f"{tmp_path}/ids").collect()}
    assert got == {k: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) for k, ids in encoded.items()}


def test_regular_texts_are_told_apart(spark):
    """Strings for which any polynomial hash modulo a power of two collides, as one piece and as pieces of several sizes."""
    word, encoder = "ab", tokens.Encoder(PATH)
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
        other = word.translate({97: 98, 98: 97})
        texts = [word, other, f" {word[:31]}", f" {other[:31]}", word]
        assert [x.tolist() for x in encoder.encode(texts)] == [library().encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    real = tokens.contents

    def colliding(*given):
        hashes, own = real(*given)
        return hashes % np.uint64(500), own

    monkeypatch.setattr(tokens, "contents", colliding)
    encoder, texts = tokens.Encoder(PATH), awkward_texts(6, 20)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [library().encode(t, add_special_tokens=False).ids for t in texts]


def test_no_documents(spark):
    assert wavelet.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, end_id=2).collect() == []
    assert [r.n_tokens for r in wavelet.token_files(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH, end_id=2).collect()] == [1]
