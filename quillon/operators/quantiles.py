"""Exact quantiles with linear interpolation, without a group's values in one place, in two reads of the input.

The first read sketches each group (KLL, mergeable, of a fixed size), which brackets each wanted rank: between two values of
the sketch a little below and above it. The second counts the values below each bracket and each value inside, and writes
these counts, a small share of the rows, in the shared folder. There the rank is closed in exactly: the values between
its bounds are counted in BINS bins, of equal width and on a logarithmic scale by turns, and the least and the greatest
value of the bin that has the rank are its next bounds, until they are equal. The driver gets BINS rows a rank at a time.

Sketches are random, results are not: a bracket that misses its rank, which its counts show, is opened to all values and
costs another read. Up to SMALL rows the second read is the aggregate percentile().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources import files

SMALL = 100_000
BINS = 256
#: Powers of two below the width of the bounds that a logarithmic scale tells apart.
FINE = 2.0**40
#: Size of a sketch, and the shares of ranks that a bracket goes beyond its rank on either side: several times the error of
#: a sketch of this size.
SKETCH, BEYOND = 2048, 0.005


def _counted(rows: DataFrame, brackets: list[tuple], kind: str) -> DataFrame:
    """(g, k, x, n) for brackets (g, k, lo, hi): how often each value inside occurs, and, where x is null, how many are
    below. One read of rows(g, x), whose counts are written."""
    bounds = rows.sparkSession.createDataFrame(brackets, f"g {kind}, k long, lo double, hi double")
    near = rows.join(F.broadcast(bounds), "g").where("x <= hi")  # two rows for each group and share
    own = near.groupBy("g", "k", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))
    return files.stored(own, "quantiles")


def _closed_in(counts: DataFrame, wanted: dict, kind: str) -> dict:
    """{(g, k): value} of wanted {(g, k): (lo, hi, rank within the values of counts(g, k, x, n) that are not null)}."""
    logarithmic = False
    while any(lo < hi for lo, hi, _ in wanted.values()):
        open_ = [(g, k, lo, hi) for (g, k), (lo, hi, _) in wanted.items() if lo < hi]
        bounds = counts.sparkSession.createDataFrame(open_, f"g {kind}, k long, lo double, hi double")
        inside = counts.join(F.broadcast(bounds), ["g", "k"]).where("x between lo and hi")
        place = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        place = F.log1p(place * FINE) / math.log1p(FINE) if logarithmic else place
        bins, logarithmic = F.least(F.floor(place * BINS), F.lit(BINS - 1)), not logarithmic
        found: dict = {}
        for r in inside.groupBy("g", "k", bins.alias("bin")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            found.setdefault((r["g"], r["k"]), []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        for key, own in found.items():
            rank = wanted[key][2]
            for _, n, lo, hi in sorted(own):
                if rank < n:
                    wanted[key] = (lo, hi, rank)
                    break
                rank -= n
    return {key: lo for key, (lo, _, _) in wanted.items()}


def exact(frame: DataFrame, group: str, value: str, shares: Sequence[float], small: int | None = None) -> dict:
    """{(group, share): quantile} of frame(group, value). NULL values count nowhere; groups without values are absent."""
    small = SMALL if small is None else small
    rows = frame.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null")
    near = lambda sketch, s: F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(s, 0.0), 1.0)))
    brackets = [(near(F.col("sketch"), s - BEYOND).alias(f"lo{i}"), near(F.col("sketch"), s + BEYOND).alias(f"hi{i}")) for i, s in enumerate(shares)]
    sketched = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.kll_sketch_agg_double("x", SKETCH).alias("sketch"))
    sizes = sketched.select("g", "n", "lo", "hi", *(c for pair in brackets for c in pair)).collect()
    if sum(r["n"] for r in sizes) <= small:
        found = rows.groupBy("g").agg(F.percentile("x", F.array(*(F.lit(float(s)) for s in shares))).alias("q")).collect()
        return {(r["g"], s): q for r in found for s, q in zip(shares, r["q"])}
    kind, asked, open_, found = dict(frame.dtypes)[group], {}, {}, {}
    for r in sizes:
        for i, s in enumerate(shares):
            for k in (math.floor((r["n"] - 1) * s), math.ceil((r["n"] - 1) * s)):
                # the ends of the sketch are those of all values
                asked[r["g"], k] = (r["lo"] if s <= BEYOND else r[f"lo{i}"], r["hi"] if s >= 1 - BEYOND else r[f"hi{i}"])
                open_[r["g"], k] = (r["lo"], r["hi"])
    while asked:
        counts = _counted(rows, [(g, k, lo, hi) for (g, k), (lo, hi) in asked.items()], kind)
        sums = {}
        for r in counts.groupBy("g", "k", F.col("x").isNull().alias("below")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            sums[r["g"], r["k"], r["below"]] = (r["n"], r["lo"], r["hi"])
        wanted, missed = {}, {}
        for g, k in asked:
            below, (n, lo, hi) = sums.get((g, k, True), (0,))[0], sums.get((g, k, False), (0, None, None))
            if below <= k < below + n:
                wanted[g, k] = (lo, hi, k - below)
            else:
                missed[g, k] = open_[g, k]
        found |= _closed_in(counts, wanted, kind)
        asked = missed
    out = {}
    for r in sizes:
        for s in shares:
            place = (r["n"] - 1) * s
            a, b = found[r["g"], math.floor(place)], found[r["g"], math.ceil(place)]
            out[r["g"], s] = a if a == b else a * (math.ceil(place) - place) + b * (place - math.floor(place))
    return out
