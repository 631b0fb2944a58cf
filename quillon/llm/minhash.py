"""MinHash near-duplicates by a signature-coordinate inverted join.

Each shingle set is posted under all its (coordinate, value) pairs. Two sets that have at least the wanted Jaccard
similarity agree on at least ``matches`` of the coordinates (but for a chance set by ``miss``), so:

* pairs (coordinate, value) of one set only are dropped, and with them each set that has fewer than ``matches`` left;
* the rest are posted only under their rarest pairs (the prefix): two sets with ``matches`` agreements share one of
  these lists. The frequent lists are skipped when lists are merged: a candidate's collisions there are counted by
  looking its values up in the other's signature. Only candidates with ``matches`` collisions in all are retained.

Texts with equal shingle sets are one set. In each posting list all members are then held against the most central one,
which links a group of copies without its pairs. What is left are members of different components that share a list and
whose signatures agree; long lists are cut in tiles, so that no task has all pairs of one. These are compared by what
they have of the shingles of that central member, as bits, and by sketches of their other shingles, which bound from
above what two sets can have in common. All pairs that this leaves possible are confirmed on full shingle sets, as the
links to the central members are, so the components lack nothing but what a signature misses.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._cluster import Scratch, connected_components, ship
from quillon.llm._text import mix, runs, shingles, utf8, words

#: Coordinates of a signature; sets are posted under each. Eight are packed in a long, eight bits each.
COORDINATES = 48
#: Members of a posting list that one task holds against others at a time.
TILE = 2_000
_LOWEST = 0x0101010101010101


def needed_matches(similarity: float, coordinates: int, miss: float) -> int:
    """The largest number of matches that a pair of this similarity falls short of with a chance of at most miss."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of (id, text)."""
    data, offsets = utf8(batch.column(1))
    for i, j in runs(offsets):
        _, _, hashes, bounds = words(data, offsets[i : j + 1])
        for row in range(i, j):
            own = shingles(hashes[bounds[row - i] : bounds[row - i + 1]], size)
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield row, own


def _print(own: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for a set: the BLAKE2b-128 digest of its sorted hashes."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signatures(size: int, coordinates: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        odd = mix(salt) | np.uint64(1)
        place = np.arange(coordinates, dtype=np.uint64) << np.uint64(40)
        for batch in batches:
            n = batch.num_rows
            count, prints, keys, packed = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, coordinates), np.uint64), np.zeros((n, coordinates), np.uint8)
            for row, own in _sets(batch, size):
                count[row] = len(own)
                if not len(own):
                    continue
                prints[row] = _print(own)
                low = np.full(coordinates, np.uint64(2**64 - 1))
                for k in range(0, len(own), 1024):
                    np.minimum(low, (((own[k : k + 1024] ^ salt) * odd) >> np.uint64(8)).min(axis=1), out=low)
                low = mix(low)
                keys[row], packed[row] = (low & np.uint64((1 << 40) - 1)) | place, low >> np.uint64(56)
            packs = packed.view(np.int64)
            keys_column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * coordinates), pa.array(keys.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), keys_column, *(pa.array(np.ascontiguousarray(packs[:, k])) for k in range(coordinates // 8))],
                names=["doc", "n", "f1", "f2", "keys", *(f"s{k}" for k in range(coordinates // 8))],
            )

    return sign


def _full_sets(size: int):
    """(node, own) of rows (id, text, node, f1, f2) whose text has the set that f1 and f2 stand for."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, total = [], [], 0

            def out(rows=rows, values=values):
                flat = pa.array(np.concatenate(values).view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "own"])

            wanted = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
            for row, own in _sets(batch, size):
                if _print(own) != wanted[row]:
                    continue  # another text of the same id
                rows.append(row)
                values.append(own)
                total += len(own)
                if total > 1 << 20:
                    yield out()
                    rows.clear()
                    values.clear()
                    total = 0
            if rows:
                yield out()

    return build


def _hub_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub, bits, hidden) of rows with both shingle sets.

    bits: which of the hub's shingles a set has, then a sketch of its others, with two bits for each shingle of the hub;
    hidden: how many of the others fell on a bit that was set. Two sets with the same hub have at most as many shingles
    in common as bits, and the smaller hidden.
    """
    for batch in batches:
        bits, hidden = [], []
        for k in range(batch.num_rows):
            own, hub = batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()
            has = np.isin(hub, own, assume_unique=True)
            others = own[np.isin(own, hub, assume_unique=True, invert=True)].view(np.uint64)
            sketch = np.zeros(2 * len(hub), bool)
            sketch[((others >> np.uint64(20)) % np.uint64(len(sketch))).astype(np.int64)] = True
            packed = np.packbits(np.concatenate((has, sketch)))
            bits.append(np.pad(packed, (0, -len(packed) % 8)).view(np.int64))
            hidden.append(len(others) - int(sketch.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.list_(pa.int64())), pa.array(hidden, pa.int64())], names=["node", "hub", "bits", "hidden"])


def _agreements(left: str, right: str, longs: int) -> Column:
    """Coordinates on which two packed signatures agree: the zero bytes of their exclusive or."""
    differ = F.lit(0)
    for k in range(longs):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        for shift in (4, 2, 1):  # gathers each byte's bits in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LOWEST)))
    return F.lit(8 * longs) - differ


def components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    coordinates: int = COORDINATES,
    tile: int = TILE,
    miss: float = 1e-6,
) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept).

    Two documents are linked when ``similarity[1] * |A & B| >= similarity[0] * |A | B|`` over their sets of
    ``shingle_words``-word shingles; with fewer words, the whole sequence is the one shingle. component_id is the
    smallest id reachable over links, the document's own included; kept marks the row whose id that is.

    Null, empty and blank texts have an empty set, are linked with nothing and kept. Rows with a null id are linked
    with nothing, have a null component_id and are kept. Repeated rows of an id get the same component_id, and all of
    them are kept or none; rows of one id with different texts count as one document that has the links of each. Ties do
    not matter. An empty table gives no rows; other columns of docs are not read. coordinates is a multiple of eight.
    """
    spark = docs.sparkSession
    num, den = similarity
    if not 0 < num <= den or coordinates % 8:
        raise ValueError("similarity must be above 0 and at most 1, and coordinates a multiple of 8")
    ship(spark)
    scratch = Scratch(spark, "minhash")
    longs = coordinates // 8
    matches = needed_matches(num / den, coordinates, miss)
    packs = [f"s{k}" for k in range(longs)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, " + ", ".join(f"{s} bigint" for s in packs)
    signed = scratch.table(texts.mapInArrow(_signatures(shingle_words, coordinates), schema).withColumn("row", F.monotonically_increasing_id()), "signatures")

    # a node is a shingle set, named by the first row that has it
    nodes = scratch.table(signed.where("n > 0 and doc is not null").groupBy("f1", "f2", "n").agg(F.min("row").alias("node"), F.min("doc").alias("first")), "nodes")
    rows = signed.select("doc", "n", "f1", "f2").join(nodes, ["f1", "f2", "n"], "left").select("doc", "n", "node", "first")
    rows = scratch.table(rows.withColumn("node", F.when(F.col("doc").isNotNull(), F.col("node"))), "rows")
    several = rows.where("node is not null").groupBy("doc").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    same_id = rows.join(several, "doc").where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    links = same_id if num == den else same_id.unionByName(_links(scratch, texts, signed, nodes, rows, shingle_words, num, den, matches, packs, tile))
    ends = connected_components(scratch, scratch.table(links, "links"))
    ends = scratch.table(ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct()), "ends")

    least = ends.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component"))
    named = ends.join(least, "root").select("node", "component")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "first", "doc"))
    per_row = rows.join(named, "node", "left").select("doc", "n", component.alias("component"))
    return per_row.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def _links(scratch: Scratch, texts: DataFrame, signed: DataFrame, nodes: DataFrame, rows: DataFrame, shingle_words: int, num: int, den: int, matches: int, packs: list[str], tile: int) -> DataFrame:
    """Links (a, b) between nodes that are similar, as many as their components need."""
    longs, coordinates = len(packs), 8 * len(packs)
    least = math.ceil(num / (den - num))  # a smaller set can only be similar to an equal one
    firsts = signed.where(F.col("n") >= least).join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    firsts = scratch.table(firsts, "firsts")
    posts = firsts.select("node", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = posts.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))
    central = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, x: a + x["df"]).alias("central")
    prefix = held.where(F.size("held") >= matches).select("node", central, F.explode(F.expr(f"slice(held.key, 1, size(held) - {matches - 1})")).alias("key"))
    lists = scratch.table(prefix, "lists")
    signature = firsts.select("node", "n", *packs)

    def sets_of(wanted: DataFrame, tag: str) -> DataFrame:
        asked = firsts.join(wanted, "node", "left_semi").select("doc", "node", "f1", "f2")
        own = texts.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "node", "f1", "f2")
        return scratch.table(own.mapInArrow(_full_sets(shingle_words), "node bigint, own array<bigint>"), tag)

    collisions = _agreements("x", "y", longs)
    alike = (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (collisions >= matches)

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
        both = with_a.join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
        sized = both.select("a", "b", F.size(F.array_intersect("own_a", "own_b")).cast("bigint").alias("common"), (F.size("own_a") + F.size("own_b")).cast("bigint").alias("sizes"))
        return sized.where(f"common * {den} >= (sizes - common) * {num}").select("a", "b")

    hubs = lists.groupBy("key").agg(F.max(F.struct("central", "node")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = lists.join(hubs.select("key", F.col("hub.node").alias("hub"), "members"), "key").where("node <> hub").select("key", "node", "hub", "members")
    members = scratch.table(members, "members")
    scratch.drop(lists)
    x, y = signature.withColumnRenamed("node", "x_node").alias("x"), signature.withColumnRenamed("node", "y_node").alias("y")
    stars = members.select("node", "hub").distinct().join(x, F.col("node") == F.col("x.x_node")).join(y, F.col("hub") == F.col("y.y_node")).where(alike)
    stars = scratch.table(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "stars")
    star_sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "star_sets")
    early = scratch.table(confirmed(stars, star_sets), "early")
    roots = scratch.table(connected_components(scratch, early), "roots")
    scratch.drop(star_sets, stars)

    # what a list still has to say are pairs without its central member
    tiles = F.ceil(F.col("members") / tile).cast("int")
    placed = members.where("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("tiles", tiles).drop("members")
    placed = scratch.table(placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")), "placed")
    scratch.drop(members)
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_lists = scratch.table(placed.join(mixed, "key", "left_semi").join(signature, "node"), "open")
    scratch.drop(placed)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.tile")) & (F.col("x.root") != F.col("y.root")) & alike
    each_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("at")
    met = open_lists.select("*", each_tile).alias("x").join(open_lists.alias("y"), apart, "left_semi").drop("at").distinct()
    met = scratch.table(met, "met")
    scratch.drop(open_lists)
    met_sets = sets_of(met.select(F.explode(F.array("node", "hub")).alias("node")).distinct(), "met_sets")
    against = met.select("node", "hub").distinct().join(met_sets, "node").join(met_sets.select(F.col("node").alias("hub"), F.col("own").alias("hub_own")), "hub")
    bits = scratch.table(against.select("node", "hub", "own", "hub_own").mapInArrow(_hub_bits, "node bigint, hub bigint, bits array<bigint>, hidden bigint"), "bits")
    last = scratch.table(met.join(bits, ["node", "hub"]), "last")
    common_bits = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda t, k: t + k)
    possible = (common_bits + F.least("x.hidden", "y.hidden")) * (num + den) >= (F.col("x.n") + F.col("y.n")) * num
    across = last.select("*", each_tile).alias("x").join(last.alias("y"), apart & (F.col("x.node") < F.col("y.node")) & possible)
    across = scratch.table(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "across")
    scratch.drop(met, bits)
    late = confirmed(across, met_sets)
    return early.unionByName(late)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without near-duplicates: one document of each group stays, that with the smallest id.

    Options are those of components(). All columns stay. Of repeated rows of a kept id, also with different texts, any
    one stays; rows with a null id all stay. An empty table gives no rows.
    """
    out = components(docs, id_col=id_col, **options)
    kept = out.where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.where(F.col(id_col).isNull()))
