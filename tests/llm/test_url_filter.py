import duckdb

from quillon.llm import queries, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, bad boolean, host string")
    options.setdefault("bad", frame["bad"])
    return {r.page_id: r for r in url_filter.judge(frame, **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        (None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("HTTP://A.Example.NET/En/x?q#f", "a.example.net", "/En/x", "net/"), ("http://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/"),
        ("https://EXAMPLE.com/de/", "example.com", "/de/", "example.com/de/"), ("https://notexample.com/de/1", "notexample.com", "/de/1", None), ("x://net", "net", "", None), ("x://net?a/b", "net", "", None),
        ("x://w.org/fr/1#a", "w.org", "/fr/1", "org/fr/"), ("a://b://c/d", "b:", "//c/d", None), ("://h/p", "h", "/p", None), ("http://É.net/é", "É.net", "/é", "net/"), ("http://h/a\nb?c", "h", "/a\nb", None),
    ]
    got = judged(spark, [(i, u, None) for i, (u, *_) in enumerate(urls)], rules=RULES)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [(h, p, r) for _, h, p, r in urls]
    says = {h + p: v for h, p, v in RULES}
    assert all(r.verdict == says.get(r.rule, "allow") for r in got.values())


def test_templates_with_bad_pages_are_rejected(spark):
    rows = [(i, f"http://h/shop/item{i}/", True if i < 12 else None) for i in range(40)]
    rows += [(100 + i, f"http://h/news/{i}.html", False if i < 12 else None) for i in range(40)]
    rows += [(200 + i, f"http://other/shop/item{i}/", None) for i in range(5)]
    got = judged(spark, rows)
    assert all(got[i].verdict == "block" for i in range(40)) and all(got[i].verdict == "allow" for i in [*range(100, 140), *range(200, 205)])
    assert got[0].template == got[39].template != got[100].template


def test_wildcards_and_merged_branches(spark):
    letters = [a + b for a in "abcdefghij" for b in "klmno"]
    rows = [(i, f"http://h/tag/{s}/{i}", True) for i, s in enumerate(letters)]
    rows += [(1000 + i, f"http://h/{b}/x/{i}", b == "p" or b == "q") for i, b in enumerate("pqr" * 8)]
    got = judged(spark, rows)
    assert len({got[i].template for i in range(len(letters))}) == 1  # fifty tags are one wildcard
    assert got[1000].template == got[1001].template != got[1002].template  # p and q look alike and are both bad
    assert got[1000].verdict == "block" and got[1002].verdict == "allow"


def test_sections_deep_in_paths_are_told_apart(spark):
    """Bad and good sections that part at the fourth or the seventh segment; short paths are judged as without them."""
    short = [(i, f"http://h/{'pq'[i % 2]}/{i}", i % 2 == 0) for i in range(12)]
    rows = [(100 * k + i, f"http://{host}/{'/'.join('abcdef'[:n])}/{section}/{i}", section == "casino") for host, n in (("x", 3), ("y", 6)) for k, section in ((n, "casino"), (n + 10, "news")) for i in range(20)]
    got = judged(spark, short + rows)
    assert {r[0]: got[r[0]].verdict for r in rows} == {r[0]: "block" if r[2] else "allow" for r in rows}
    assert len({got[r[0]].template for r in rows}) == 4 and got[300].template.endswith("/b/c/casino/#")
    letters = [a + b for a in "abcdefghij" for b in "klmno"]
    wide = judged(spark, [(i, f"http://z/a/b/c/d/{s}/{i}", True) for i, s in enumerate(letters)])
    assert {r.template.split("/")[-2:] == ["*", "#"] for r in wide.values()} == {True} and len({r.template for r in wide.values()}) == 1
    alone = judged(spark, [*short, *((r[0], r[1].replace("http://y/a/b/c/d/e/f", "http://y/a/b/c"), r[2]) for r in rows)])
    assert [(got[i].template, got[i].badness) for i, *_ in short] == [(alone[i].template, alone[i].badness) for i, *_ in short]


def test_similar_siblings_are_merged_at_every_level_and_different_ones_are_not(spark):
    rows, n = [], 0
    for top in ("a", "b"):
        for section, bad in (("one", 0.9), ("two", 0.85), ("three", 0.1), ("four", 0.1), ("five", 0.1)):
            for i in range(20):
                rows.append((n := n + 1, f"http://h/{top}/{section}/{i}", i < 20 * bad))
    rows.append((n + 1, "http://h/a/new/1", None))
    got = judged(spark, rows)
    of = {u.split("/", 3)[3].rsplit("/", 1)[0]: got[k].template for k, u, _ in rows}
    assert of["a/one"] == of["b/one"] == of["a/two"] != of["a/three"] == of["b/four"] and of["a/new"] not in (of["a/one"], of["a/three"])
    assert got[1].verdict == "block" and got[50].verdict == "allow" == got[n].verdict


def test_long_paths_keep_their_rest(spark):
    deep = "/".join(f"s{i % 3}" for i in range(300))
    rows = [(i, f"http://h/{deep}/{'good' if i % 2 else 'bad'}/x", i % 2 == 0) for i in range(24)] + [(100, "http://h/" + "q/" * 100_000, None)]
    got = judged(spark, rows)
    assert {got[i].verdict for i in range(0, 24, 2)} == {"block"} and {got[i].verdict for i in range(1, 24, 2)} == {"allow"}


def test_empty_table_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "http://h/x"), (None, "http://h/x")], "page_id long, url string")
    assert [(r.page_id, r.verdict) for r in url_filter.judge(frame).collect()] == [(None, "allow")] * 2
    assert url_filter.judge(frame.limit(0), rules=RULES).collect() == []


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("pages", "labels", "documents"):
        c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    for name in ("op9_url_filter", "op5_mixing", "op6_exact_dedup", "op1_minhash"):
        got = queries.QUERIES[name](spark, folder)
        want = c.sql(queries.ORACLE_SQL[name])
        at = [want.columns.index(x) for x in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
