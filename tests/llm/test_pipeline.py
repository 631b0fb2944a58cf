import random
import re
import zlib

import corpus_pipeline
from quillon.llm import decontaminate, langid, minhash, wavelet
from tests.llm.test_decontaminate import smith_waterman
from tests.llm.test_mixing import brute_force as mix_by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(11)
    vocabularies = {"en": ["".join(r.choice(("th", "an", "er", "in", "ou")) for _ in range(r.randrange(1, 4))) for _ in range(300)], "de": ["".join(r.choice(("sch", "ung", "ver", "kei", "ß")) for _ in range(r.randrange(1, 4))) for _ in range(300)]}
    text = lambda lang, n: " ".join(r.choice(vocabularies[lang]) for _ in range(n))
    items = [(k, text(lang, 25)) for k, lang in enumerate(("en", "de", "en"))]
    rows = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        rows.append([i, text(lang, r.choice((6, 40, 90))), lang, f"src{r.choice((0, 0, 0, 1, 12))}"])
    for i in range(0, 30, 3):
        rows[100 + i][1] = rows[i][1] + " more"  # near and not so near copies
        rows[101 + i][1] = rows[i + 1][1].upper()
    for i in range(60, 75, 5):
        rows[i][1] += " " + items[i % 3][1]
    rows[80][1], rows[81][1], rows[82][1] = None, "", "12 34 !!"
    return [(*row, len(row[1] or "")) for row in rows], items


def write(spark, folder):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_by_brute_force(spark, tmp_path):
    rows, items = write(spark, tmp_path)
    # language ID: the model judges, the stage keeps what it does not reject
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    models = langid.learn(docs)
    rejected = dict(zip((r[0] for r in rows), langid.judge(models, [r[1] or "" for r in rows])[3]))
    assert {k for k, x in rejected.items() if x} == {80, 81, 82}
    kept = [r for r in rows if not rejected[r[0]]]
    # near-duplicates
    root = {r[0]: r[0] for r in kept}
    find = lambda x: x if root[x] == x else find(root[x])
    sets = {r[0]: shingles(r[1]) for r in kept}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [r for r in kept if find(r[0]) == r[0]]
    assert len(kept) < 150
    # contaminated documents
    split = re.compile(r"[^\W_]+").findall
    score = lambda t: max(smith_waterman(split(x), split(t.lower())) / (2 * len(split(x))) for _, x in items)
    kept = [r for r in kept if score(r[1]) < decontaminate.LIMIT]
    # mixing
    chosen, _ = mix_by_hand([r[:4] for r in kept], corpus_pipeline.MIX["budget"], 1, corpus_pipeline.MIX["seed"], corpus_pipeline.MIX["weights"])
    ids = {eval(x)[0] for x in chosen}  # noqa: S307
    kept = sorted(r for r in kept if r[0] in ids)
    # token files
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), [], 0
    for r in kept:
        own = [*library.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
        start += len(own)
    before = len(corpus_pipeline.shard_folders(spark))
    for run in (1, 2):  # twice in a session, each with shards of its own that stay
        assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
        folders = corpus_pipeline.shard_folders(spark)
        assert len(folders) == before + run
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.documents(spark, folders[-1]).collect()) == want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    extra = docs.selectExpr("*", "1 AS doc", "'k' AS key", "2 AS n", "3 AS _times", "'x' AS host")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, str(tmp_path))
        assert set(out.columns) == set(extra.columns) and out.count() > 0
        empty = stage(spark, extra.limit(0), str(tmp_path))
        assert set(empty.columns) == set(extra.columns) and empty.count() == 0
    assert minhash.drop_near_duplicates(extra).count() < docs.count()
