"""Mixing sources to target weights, by hierarchical budgeting. DataFrame functions only.

The leaves of the tree are (domain, lang, source). A token budget goes down the tree: the children of a node share its
budget by their weights, a child takes no more than its leaves can supply in the allowed epochs, and what it leaves goes
to its siblings by their weights. Only when all siblings are full does a shortage reach the node above, where the node
counts as full itself. A leaf supplies nothing where it or a node above it has no weight. Each leaf then gives whole
epochs, and of one more epoch the prefix that its budget allows, in an order seeded anew for each epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order that make a bucket; a leaf's prefix ends in one of 16**BUCKET_DIGITS buckets.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def share_out(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Add ``given`` to children(*parent, name, weight, supply, budget): their parts of the parent's budget.

    In the order of supply by weight, a child is full when its part of what the children before it leave is no less than
    its supply; so full children come first. The rest share what is left by weight, rounded down, and the tokens lost by
    rounding go one each to the first of them by name. Children without positive weight get nothing, and a parent's
    budget is no more than the others' supply. A window has the children of one parent, which are nodes of the tree.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    own = children.where("weight > 0")
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("supply") / F.col("weight"), name)
    own = own.withColumn("before", F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("full", (big("budget") - big("before")) * big("weight") >= big("supply") * big("weight_left"))
    own = own.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(group), F.lit(0)))
    own = own.withColumn("weights", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    own = own.withColumn("part", F.when(F.col("full"), F.col("supply")).otherwise(F.expr("cast(cast(left as decimal(38,0)) * weight div weights as bigint)")))
    own = own.withColumn("lost", F.col("budget") - F.sum("part").over(group))
    own = own.withColumn("turn", F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(group.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("given", F.col("part") + F.when(~F.col("full") & (F.col("turn") <= F.col("lost")), 1).otherwise(0))
    return own.drop("before", "weight_left", "full", "left", "weights", "part", "lost", "turn")


def _weight(weights: Mapping[str, int] | None, column: str) -> Column:
    if not weights:
        return F.lit(1).cast("bigint")
    pairs = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.element_at(pairs, F.col(column)), F.lit(1)).cast("bigint")


def budgets(leaves: DataFrame, *, budget: tuple[int, int], max_epochs: int, weights: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Add ``given`` to leaves(domain, lang, source, tokens): the tokens to take from each.

    The whole budget is the fraction ``budget`` of all tokens. ``weights`` has whole weights by level and child name;
    children that it does not name weigh 1.
    """
    weights = weights or {}
    numerator, denominator = budget
    weighed = reduce(lambda x, y: x & y, (_weight(weights.get(level), level) > 0 for level in LEVELS))
    supply = leaves.select(*LEVELS, "tokens", F.when(weighed, F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("bigint")).alias("supply"))
    total = supply.agg(F.expr(f"cast(sum(cast(tokens as decimal(38,0))) * {numerator} div {denominator} as bigint)").alias("wanted"), F.sum("supply").alias("most"))
    node = supply.crossJoin(total.select(F.least("wanted", "most").alias("budget")))  # one row
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = node.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.first("budget").alias("budget")).withColumn("weight", _weight(weights.get(level), level))
        given = share_out(children, keys[:-1], level).select(*keys, F.col("given").alias("budget"))
        node = node.drop("budget").join(given, keys)
    return node.select(*LEVELS, "tokens", F.col("budget").alias("given"))


def _described(domain: Column | None, tokens: Column | None, id_col: str, text_col: str) -> list[Column]:
    """Columns of the rows: doc_id, the leaf, tokens and text_md5."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return [
        F.col(id_col).cast("bigint").alias("doc_id"), (F.left(source, F.lit(4)) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), (words(text) if tokens is None else tokens.cast("bigint")).alias("tokens"), F.md5(text).alias("text_md5"),
    ]


def select(
    docs: DataFrame,
    *,
    budget: tuple[int, int],
    max_epochs: int,
    seed: int,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    domain: Column | None = None,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The selected rows: (doc_id, domain, lang, source, tokens, epoch, text_md5), one for each epoch that takes a row.

    domain is by default the first four characters of the source, tokens the words of the whole text. Null languages,
    sources and texts count as empty. In an epoch, a leaf's rows are ordered by the MD5 of seed, epoch, id and text; the
    last epoch of a leaf ends before the first row that exceeds its budget. Repeated rows are rows of their own and tie;
    rows with a null id take part. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(docs.select(*_described(domain, tokens, id_col, text_col)), "rows")
    return _selected(scratch, rows, budget=budget, max_epochs=max_epochs, seed=seed, weights=weights)


def _selected(scratch: Scratch, rows: DataFrame, *, budget: tuple[int, int], max_epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]] | None) -> DataFrame:
    """select() of a written table of _described() rows."""
    leaves = scratch.table(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "leaves")
    plan = budgets(leaves, budget=budget, max_epochs=max_epochs, weights=weights).where("given > 0")
    plan = scratch.table(plan.select(*LEVELS, F.expr("given div tokens").alias("whole"), (F.col("given") % F.col("tokens")).alias("rest")), "plan")
    placed = rows.join(plan, list(LEVELS))  # the plan is a written table of known size, broadcast where it is small

    full = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("whole"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5")))
    part = placed.where("rest > 0").withColumn("key", key).withColumn("bucket", F.left("key", F.lit(BUCKET_DIGITS)))
    sums = part.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("in_bucket"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("in_bucket").over(upto))
    # buckets that end within the rest are taken whole; the first beyond it is cut
    cut = sums.where(F.col("upto") - F.col("in_bucket") <= F.col("rest")).select(*LEVELS, "bucket", F.when(F.col("upto") > F.col("rest"), F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("room"))
    cut = scratch.table(cut, "buckets")
    met = part.join(cut, [*LEVELS, "bucket"])
    inside = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = met.where("room is not null").withColumn("run", F.sum("tokens").over(inside)).where("run <= room")
    last = met.where("room is null").select(*rows.columns, (F.col("whole") + 1).alias("epoch")).unionByName(ends.select(*rows.columns, (F.col("whole") + 1).alias("epoch")))
    return full.select(*rows.columns, "epoch").unionByName(last).select("doc_id", *LEVELS, "tokens", "epoch", "text_md5")


def mixed(
    docs: DataFrame,
    *,
    budget: tuple[int, int],
    max_epochs: int,
    seed: int,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    domain: Column | None = None,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of docs that select() takes, with all their columns; once for each epoch that takes them.

    Null languages, sources and texts count as empty, and texts without tokens are taken whenever their place comes. Rows
    with equal id, text and leaf tie: their takings are dealt to them evenly, and the first ones in the table have what
    that leaves over. Rows with a null id take part; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    own = _described(domain, tokens, id_col, text_col)
    rows = scratch.table(docs.select(*own), "rows")
    # rows that are equal here have equally many tokens, unless these are given
    keys = ["doc_id", *LEVELS, "text_md5", *(["tokens"] if tokens is not None else [])]
    taken = _selected(scratch, rows, budget=budget, max_epochs=max_epochs, seed=seed, weights=weights).groupBy(*keys).agg(F.count("*").alias("rows_taken"))
    there = rows.groupBy(*keys).agg(F.count("*").alias("rows_there"))
    times = taken.alias("a").join(there.alias("b"), _same("a", "b", keys)).select("a.*", F.expr("rows_taken div rows_there").alias("times"), (F.col("rows_taken") % F.col("rows_there")).alias("over"))
    times = scratch.table(times, "times")
    whole = docs.select(F.struct("*").alias("row"), *own).alias("w")
    each = whole.join(times.where("times > 0").alias("t"), _same("w", "t", keys)).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*")
    left = scratch.table(times.where("over > 0"), "over")  # its size is known then, and where it is small no text is shuffled
    if left.isEmpty():
        return each
    first = Window.partitionBy(*(f"t.{k}" for k in keys)).orderBy("place")
    rest = whole.withColumn("place", F.monotonically_increasing_id()).alias("w").join(left.alias("t"), _same("w", "t", keys))
    rest = rest.withColumn("nth", F.row_number().over(first)).where("nth <= over")
    return each.unionByName(rest.select("row.*"))


def _same(one: str, other: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{one}.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys))
