"""URL filters by rules and path-template trees. DataFrame functions only.

The paths of a host make a tree of segments, with runs of digits as one sign. It is built from the host down. Where a
node has many children, the rare ones are one wildcard. Of the others, those with enough labelled pages are tested
against their node: children whose share of bad pages is significantly below the node's, or above it, or not different
from it, are merged with those of the same finding, and their subtrees with them. A template is rejected when the share
of bad pages among its labelled ones, smoothed towards that of the nodes above it, reaches a limit. Hosts without
labelled pages lose nothing. Rules come before the trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch

#: Levels of the tree. The segments of longer paths from this level on are one, whole.
DEPTH = 8
#: A node with more children than this has its rare ones, below the share, generalised.
WIDE, RARE = 16, 0.05
#: Labelled pages that a child needs to be tested, and the chi-square of one degree of freedom that is significant (5 %).
ENOUGH, SIGNIFICANT = 5, 3.841459
#: Labelled pages' worth of the node above in each purity, and the share of bad ones from which on a template is rejected.
SMOOTHING, LIMIT = 4.0, 0.5
#: What no segment can be: a wildcard, and the end of the name of merged children.
WILD, MERGED = "/*", "/+"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end with A-Z lower-cased, and from there up
    to ``?``, ``#`` or the end. Both are empty where url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits: its host or a subdomain, and the start of the
    path. Of equally long ones the first given; nulls where none fits."""
    rule = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _segments(path: Column, depth: int) -> Column:
    found = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    rest = F.array(F.array_join(F.slice(found, depth, F.greatest(F.size(found), F.lit(depth))), "/"))
    return F.when(F.size(found) > depth, F.concat(F.slice(found, 1, depth - 1), rest)).otherwise(found)


def _smoothed(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + SMOOTHING * above) / (labelled + SMOOTHING)


def _level(tree: DataFrame, k: int) -> DataFrame:
    """The tree with the k-th segments' names added to its nodes, and their purities in place of those above.

    Children of a node are aggregated before each shuffle; where they are many, the rare ones become one, so a window
    has at most 1 / RARE + 1 of them.
    """
    segment = F.get("segments", F.lit(k))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")] + [F.max("purity").alias("purity")]
    child = tree.where(segment.isNotNull()).groupBy("host", "node", segment.alias("segment")).agg(*sums)
    whole = child.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("node_n"))
    rare = (F.col("kinds") > WIDE) & (F.col("n") < RARE * F.col("node_n"))
    named = child.join(whole, ["host", "node"]).withColumn("token", F.when(rare, F.lit(WILD)).otherwise(F.col("segment")))

    siblings, alike = Window.partitionBy("host", "node"), Window.partitionBy("host", "node", "finding")
    tested = named.groupBy("host", "node", "token").agg(*sums).withColumn("all_bad", F.sum("bad").over(siblings)).withColumn("all_labelled", F.sum("labelled").over(siblings))
    apart = (F.col("bad") * F.col("all_labelled") - F.col("all_bad") * F.col("labelled")).cast("double")
    chance = SIGNIFICANT * F.col("labelled") * F.col("all_bad") * (F.col("all_labelled") - F.col("all_bad"))
    finding = F.when(apart * apart <= chance, "=").when(apart > 0, "+").otherwise("-")
    tested = tested.withColumn("finding", F.when(F.col("labelled") >= ENOUGH, finding).otherwise(F.concat(F.lit("/"), "token")))
    name = F.concat(F.min("token").over(alike), F.when(F.count("*").over(alike) > 1, MERGED).otherwise(""))
    branches = tested.select("host", "node", "token", name.alias("name"), _smoothed(F.sum("bad").over(alike), F.sum("labelled").over(alike), F.col("purity")).alias("branch_purity"))

    found = named.select("host", "node", "segment", "token").join(branches, ["host", "node", "token"]).drop("token")
    both = tree.withColumn("segment", segment).join(found, ["host", "node", "segment"], "left")
    return both.select("host", "segments", "n", "labelled", "bad", F.when(F.col("name").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "name")).alias("node"), F.coalesce("branch_purity", "purity").alias("purity"))


def _judged(scratch: Scratch, counted: DataFrame) -> DataFrame:
    """(host, segments, template, badness) of counted(host, segments, n, labelled, bad). Each level is written, as the
    next one reads it twice."""
    share = counted.agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    share = share.select(F.least((F.coalesce("all_bad", F.lit(0)) + 1.0) / (F.coalesce("all_labelled", F.lit(0)) + 10.0), F.lit(LIMIT / 2)).alias("prior"))
    hosts = counted.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("labelled").alias("host_labelled")).crossJoin(share)  # one row
    hosts = hosts.select("host", F.lit("").alias("node"), _smoothed(F.col("host_bad"), F.col("host_labelled"), F.col("prior")).alias("purity"))
    tree = counted.join(hosts, "host")
    for k in range(counted.agg(F.max(F.size("segments"))).first()[0] or 0):
        tree = scratch.table(_level(tree, k), "level")
    return tree.select("host", "segments", F.concat("host", "node").alias("template"), F.col("purity").alias("badness"))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = (), bad: Column | None = None, depth: int = DEPTH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict, template, badness).

    ``bad`` is a boolean column of pages that labels a page as bad or good, or is null. verdict is that of the longest
    fitting rule, else ``block`` where the page's template is rejected, else ``allow``. Null urls and urls without
    ``://`` have an empty host and path; they share one template. Repeated rows are judged alike, and count again in the
    trees; null ids stay null. Paths of more than ``depth`` segments have the rest of the path as their last one, so none
    are taken for each other. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col(url_col).cast("string"))
    label = F.lit(None).cast("boolean") if bad is None else bad
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), label.alias("is_bad"))
    rows = scratch.table(rows.withColumn("segments", _segments(F.col("path"), depth)), "rows")
    counted = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.sum(F.when(F.col("is_bad"), 1).otherwise(0)).alias("bad"))
    verdicts = _judged(scratch, scratch.table(counted, "templates"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    named = rows.join(verdicts, ["host", "segments"])
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("badness") >= LIMIT, "block").otherwise("allow")).alias("verdict"), "template", "badness")
