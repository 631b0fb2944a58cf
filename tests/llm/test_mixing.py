import hashlib
import random
from fractions import Fraction

import pytest

from quillon.llm import mixing

WORDS = lambda t: len((t or "").split())


def water(budget, children):
    """children: {name: (weight, supply)}; the shares by bisection over saturated sets, then the rounding rule."""
    given, left, open_ = {}, budget, {k: v for k, v in children.items() if v[0] > 0}
    while True:
        weight = sum(w for w, _ in open_.values())
        full = {k for k, (w, s) in open_.items() if Fraction(left * w, weight) >= s} if weight else set()
        if not full:
            break
        for k in full:
            given[k] = open_.pop(k)[1]
        left = budget - sum(given.values())
    lost = left
    for k, (w, _) in open_.items():
        given[k] = left * w // weight
        lost -= given[k]
    for k in sorted(open_)[:lost]:
        given[k] += 1
    return given


def brute_force(rows, budget, epochs, seed, weights):
    tree = {}
    for k, t, lang, source in rows:
        leaf = ((source or "")[:4], lang or "", source or "")
        tree.setdefault(leaf, []).append((k, t or ""))
    supply = {leaf: sum(WORDS(t) for _, t in own) for leaf, own in tree.items()}
    supply = {k: v for k, v in supply.items() if v}
    weight = lambda level, name: weights.get(level, {}).get(name, 1)

    useful = {leaf: s * epochs * all(weight(level, name) > 0 for level, name in zip(mixing.LEVELS, leaf)) for leaf, s in supply.items()}

    def hand(budget, prefix):
        if len(prefix) == 3:
            return {prefix: budget}
        level = mixing.LEVELS[len(prefix)]
        below = {}
        for leaf, s in useful.items():
            if leaf[: len(prefix)] == prefix:
                below[leaf[len(prefix)]] = below.get(leaf[len(prefix)], 0) + s
        out = {}
        for n, b in water(budget, {n: (weight(level, n), s) for n, s in below.items()}).items():
            out |= hand(b, (*prefix, n))
        return out

    total = sum(supply.values())
    given = hand(min(total * budget[0] // budget[1], sum(useful.values())), ())
    out = []
    for leaf, b in given.items():
        whole, rest = divmod(b, supply[leaf])
        out += [(k, *leaf, WORDS(t), e) for k, t in tree[leaf] for e in range(1, whole + 1)]
        order = sorted(tree[leaf], key=lambda r: hashlib.md5(f"{seed}:{whole + 1}:{'' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest())
        run = 0
        for k, t in order if rest else []:
            run += WORDS(t)
            if run > rest:
                break
            out.append((k, *leaf, WORDS(t), whole + 1))
    return sorted(map(str, out)), given


def corpus(seed, n=400):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice((0, 1, 5, 60)))), r.choice(("en", "en", "en", "de", None)), f"src{r.choice((0, 0, 0, 0, 1, 12, 2))}") for i in range(n)]
    return rows + [(None, "no id here", "en", "src1"), (7, "again w", "en", None), (7, "again w", "en", None), (8, None, None, None)]


@pytest.mark.parametrize(("budget", "epochs", "weights"), [((1, 2), 1, {}), ((3, 5), 2, {"lang": {"en": 1, "de": 5}}), ((9, 10), 1, {"domain": {"src1": 7}, "source": {"src12": 3}}), ((5, 1), 3, {}), ((1, 3), 2, {"lang": {"de": 0}}), ((0, 1), 1, {})])
def test_matches_brute_force(spark, budget, epochs, weights):
    rows = corpus(budget[0])
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, epoch int").repartition(3)
    want, _ = brute_force(rows, budget, epochs, 7, weights)
    found = mixing.select(frame, budget=budget, max_epochs=epochs, seed=7, weights=weights)
    assert sorted(str(tuple(r)[:6]) for r in found.collect()) == want


def test_shuffled_leaves_give_the_same(spark):
    rows = corpus(9)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(str(tuple(r)[:6]) for r in mixing.select(frame, budget=(1, 2), max_epochs=1, seed=7).collect()) == brute_force(rows, (1, 2), 1, 7, {})[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_shortage_below_goes_to_siblings_above(spark):
    """Half of the first domain has no weight: what it cannot give comes from the second, up to the whole budget."""
    leaves = spark.createDataFrame([("AAAA", "x", "s", 100), ("AAAA", "y", "s", 10), ("BBBB", "y", "s", 100)], "domain string, lang string, source string, tokens long")
    given = {(r.domain, r.lang): r.given for r in mixing.budgets(leaves, budget=(1, 2), max_epochs=1, weights={"lang": {"x": 0}}).collect()}
    assert given == {("AAAA", "y"): 10, ("BBBB", "y"): 95}


def test_whole_rows(spark):
    rows = corpus(4, 60)
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, tokens string")
    want = mixing.select(frame, budget=(3, 2), max_epochs=2, seed=1)
    got = mixing.mixed(frame, budget=(3, 2), max_epochs=2, seed=1)
    assert got.columns == frame.columns and sorted(str((r.doc_id, r.source or "")) for r in got.collect()) == sorted(str((r.doc_id, r.source)) for r in want.collect())


def test_equal_rows_share_what_is_taken(spark):
    """Two equal rows of which the cut takes one, three of which it takes two, and equal texts in two sources of which one is taken."""
    rows = [(1, "a b", "en", "src1", k) for k in range(2)] + [(None, "a b c", "en", "src2", k) for k in range(3)] + [(5, "x", "en", s, s) for s in ("src3", "src4")]
    frame = spark.createDataFrame([(*r[:4], str(r[4])) for r in rows], "doc_id long, text string, lang string, source string, extra string").repartition(3)
    for budget, epochs, weights in (((2, 3), 1, {}), ((3, 2), 2, {"source": {"src3": 0}})):
        options = {"budget": budget, "max_epochs": epochs, "weights": weights, "seed": 3}
        want = sorted(str((r.doc_id, r.source, r.tokens)) for r in mixing.select(frame, **options).collect())
        got = mixing.mixed(frame, **options).collect()
        assert sorted(str((r.doc_id, r.source, WORDS(r.text))) for r in got) == want and want


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.select(frame, budget=(1, 2), max_epochs=1, seed=1).collect() == []
