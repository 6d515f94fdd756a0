"""Exact n-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows.

Distance: 1 - |x & y| / |x | y| between sets of word shingles; documents link within the radius 1 - PERCENT / 100.

1. Equal sets are merged, so a group of copies is one point.
2. Points that cannot have a neighbour leave: a neighbour shares three quarters of a set, so a set of which more
   than a quarter of the shingles occur in no other set is alone. Counting a fixed third of all hashes is enough
   to see that for most; then it is counted exactly among the sets that stay.
3. Almost all distances between texts are 1, so pivots drawn from all documents would leave one region. The first pivots
   are therefore shingles, those that the fewest sets hold coming first: two sets within the radius share one of the first
   quarter (plus one) of their shingles, so the sets around such a shingle form a region. They share nothing before the
   first common shingle: pairs with too little left from there on don't link.
4. Each set is compared with the most central set (that of the most widespread shingles) of each of its regions. That
   links nearly all near copies, and a region whose sets are all in one component is settled.
5. In the others, sets outside of the central set's component become pivots, a few a region, and are compared with all sets of it.
   If more such sets are left, the region falls into Voronoi cells: each set goes home to its nearest pivot and also into
   every cell whose pivot is at most two radii farther (triangle inequality). The cells are the regions of the next round,
   without the pivots, which are settled.

A cell holds the sets at home in it and those that only border it. Two that only border it meet where one is at
home. That holds for each level of cells by itself, so a row carries one bit a level, set where it only borders, and
a pair is skipped where both have the same bit.

Only distances to pivots are computed, no pairs within a region are listed, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.llm.bytewords import chunks, mix, row_of, shingle_hashes
from captionlake.llm.components import components
from captionlake.llm.tables import discard, materialize

SHINGLE = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pivots of a region in the first round of cells; four times as many each later round, up to MOST_PIVOTS.
FIRST_PIVOTS = 32
MOST_PIVOTS = 512
#: Pivots, of the most central ones, that make cells: the others settle pairs only.
CELL_PIVOTS = 8
#: A region is cut into cells where these hold at most so many times its rows.
REPLICAS = 2
#: Of the regions before this one in a set's order, the last so many go with its row: a pair that has one of them in common has met there.
BEFORE = 8
#: Levels of cells that have a bit; the copies of later levels have none, so their pairs may be met twice.
LEVELS = 62
#: Two sets of n and m can link, if the shingle of this region is the first in order that both have: they share no more than what is left from
#: there on. Where it is not the first, they have met in the region of that one.
_ENOUGH = "least(left, pivot_left) * (100 + {0}) >= {0} * (n + m)"
_THIRD = np.uint64(3)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of (first row, rows, row of each shingle, shingle hash): the distinct shingles, sorted by row and hash."""
    for c in chunks(column, lower=True):
        start, end, first = c.words()
        words, row, count = c.hashes(start, end), row_of(first), np.diff(first)
        grams = shingle_hashes(words, k)
        at = np.flatnonzero(row[: len(grams)] == row[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
        rows, hashes = [row[at]], [grams[at]]
        for m in range(1, k):  # a text of fewer words is one shingle, of its own kind
            short = np.flatnonzero(count == m)
            if len(short):
                rows.append(short)
                h = np.full(len(short), m, np.uint64)
                for i in range(m):
                    h = mix(h + words[first[short] + i])
                hashes.append(mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)))
        r, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        yield c.lo, c.rows, r[new], h[new]


def _names(rows: int, r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's set size and a 128-bit name of its set."""
    edges = np.searchsorted(r, np.arange(rows + 1))
    out = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return np.diff(edges), out[0], out[1]


def _name_job(k: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_names(rows, r, h) for _, rows, r, h in shingle_sets(batch.column("text"), k)]
            if parts:
                n, k1, k2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2)], names=["doc_id", "n", "k1", "k2"])

    return job


def _third_job(k: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, r, h in shingle_sets(batch.column("text"), k):
                _, k1, _ = _names(rows, r, h)
                at = np.flatnonzero(h % _THIRD == 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(k1[r[at]])], names=["h", "k1"])

    return job


def _set_job(k: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want1, want2 = (batch.column(x).to_numpy() for x in ("node", "k1", "k2"))
            for lo, rows, r, h in shingle_sets(batch.column("text"), k):
                n, k1, k2 = _names(rows, r, h)
                ok = (k1 == want1[lo : lo + rows]) & (k2 == want2[lo : lo + rows])
                edges = np.searchsorted(r, np.arange(rows + 1))
                sets = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                table = pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + rows]), pa.array(n), sets], names=["node", "n", "set"])
                yield table.filter(pa.array(ok))

    return job


def _most_alone(n: str, percent: int) -> F.Column:
    """How many shingles a set of n can have that its neighbour lacks."""
    return F.expr(f"{n} - (({percent} * {n} + 99) div 100)")


def _peeled(sets: DataFrame, percent: int) -> DataFrame:
    """The sets of which enough shingles occur in another of these sets too; again until few leave."""
    while True:
        before = sets.count()
        only = sets.select("node", F.explode("set").alias("g")).groupBy("g").agg(F.min("node").alias("node"), F.max("node").alias("hi"))
        only = only.where("node = hi").groupBy("node").agg(F.count("*").alias("alone"))
        kept = materialize(sets.join(only, "node", "left").where(F.coalesce("alone", F.lit(0)) <= _most_alone("n", percent)).drop("alone"))
        discard(sets)
        sets = kept
        if sets.count() * 10 >= before * 9:
            return sets


def shingle_regions(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, set, rank, keys): each set once, its place in the order of centrality, and the regions of its first shingles.

    Shingles are ordered by how many sets hold them, then by which sets these are. Of shingles that the same sets hold only the
    first makes a region, as the others would hold the same pairs; left counts a set's shingles from that one on, before holds the
    set's last regions before it. The rank is least for sets of widespread shingles.
    """
    rows = sets.select("node", F.explode("set").alias("g"))
    held = materialize(rows.groupBy("g").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("who")))
    order = rows.join(held, "g").groupBy("node").agg(F.collect_set(F.struct("df", "who", "g")).alias("o"), F.avg("df").alias("spread"))
    full = sets.select("node", "n").distinct().join(order, "node").withColumn("o", F.array_sort("o"))
    first = F.slice("o", F.lit(1), (_most_alone("n", percent) + 1).cast("int"))
    other = lambda x, i: (i == 0) | (x["who"] != F.get("o", i - 1)["who"]) | (x["df"] != F.get("o", i - 1)["df"])
    keys = F.transform(first, lambda x, i: F.struct(F.xxhash64(x["df"], x["who"]).alias("key"), (F.col("n") - i).alias("left"), ((x["df"] > 1) & other(x, i)).alias("new")))
    keys = F.filter(keys, lambda x: x["new"])
    before = lambda i: F.slice(F.col("keys.key"), F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE)))
    told = F.transform("keys", lambda x, i: F.struct(x["key"].alias("key"), x["left"].alias("left"), before(i).alias("before")))
    central = (F.lit(1 << 31) - F.least(F.col("spread") * 256, F.lit(1 << 30))).cast("long") * (1 << 31)
    rank = central + F.pmod(F.xxhash64("node"), F.lit(1 << 31))
    full = full.select("node", "n", F.col("o.g").alias("set"), rank.alias("rank"), keys.alias("keys"))
    out = materialize(full.withColumn("keys", told))
    discard(held)
    return out


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with their intersection and union sizes."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.col("na") + F.col("nb") - both).alias("either"))


def _linked(known: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame | None:
    """comps (node, component) with the links among known pairs added; None while there is no link at all."""
    new = known.where(f"100 * both >= {percent} * either").select("u", "v")
    if comps is not None:
        a = comps.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        b = comps.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        new = new.join(a, "u", "left").join(b, "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    new = materialize(new)
    if new.isEmpty():
        return comps
    edges = new if comps is None else new.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return materialize(components(edges))


def _with_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of regions that can hold an unsettled pair, marked as active where they are not in the component of the most central set.

    A region is settled when all its sets are in one component, or all only border it on one level.
    """
    alive = rows.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_and("edges").alias("all"), F.min_by("comp", "rank").alias("main"), F.count("*").alias("members")
    )
    alive = alive.where("lo < hi AND all = 0").select("key", "main", "members")
    return rows.join(alive, "key").withColumn("active", F.col("comp") != F.col("main")).drop("main")


def _cells(rows: DataFrame, near: DataFrame, level: int, radius: float) -> DataFrame:
    """The Voronoi cells of regions with more active sets than pivots, without the pivots.

    A set's home is the cell of its nearest pivot. If it is within the radius of a set with another home, its distance to that
    pivot is at most two radii more than to its own, by the triangle inequality: it borders all such cells. A region that its borders
    would blow up to more than REPLICAS times its size stays whole.
    """
    least = near.groupBy("key", "node").agg(F.min(F.struct("away", "pivot")).alias("home"))
    put = near.join(least, ["key", "node"]).where(F.col("away") <= F.col("home.away") + 2 * radius + 1e-9)
    put = put.select("key", "node", "pivot", (F.col("pivot") != F.col("home.pivot")).alias("border"))
    put = materialize(put)
    much = put.groupBy("key").agg(F.count("*").alias("copies"), F.countDistinct("node").alias("rest")).withColumn("whole", F.col("copies") > REPLICAS * F.col("rest"))
    mark = F.lit(1 << level if level < LEVELS else 0).cast("long")
    kept = rows.select("key", "node", "n", "left", "before", "rank", "edges").join(much.select("key", "whole"), "key")
    whole = kept.where("whole").join(put.select("key", "node").distinct(), ["key", "node"]).drop("whole")
    split = kept.where("NOT whole").drop("whole").join(put, ["key", "node"])
    split = split.select(
        F.xxhash64("key", "pivot").alias("key"), "node", "n", "left", "before", "rank", F.when(F.col("border"), F.col("edges").bitwiseOR(mark)).otherwise(F.col("edges")).alias("edges")
    )
    out = materialize(whole.unionByName(split))
    discard(put)
    return out


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, component) for all sets (node, n, set) that link with another; None if none does."""
    radius = 1 - percent / 100
    sets = shingle_regions(sets, percent)
    rows = sets.select("node", "n", "rank", F.lit(0).cast("long").alias("edges"), F.explode("keys").alias("k")).select("node", "n", "rank", "edges", "k.key", "k.left", "k.before")
    # a set that is too small from the region's shingle on, even for the region's smallest set, has no link here
    least = rows.groupBy("key").agg(F.min("n").alias("m"), F.count("*").alias("members")).where("members > 1").select("key", "m")
    rows = materialize(rows.join(least, "key").where(f"left * {100 + percent} >= {percent} * (n + m)").drop("m"))
    # first every set against the most central one of each of its regions
    heads = rows.groupBy("key").agg(F.min_by("node", "rank").alias("pivot"), F.min_by("n", "rank").alias("m"), F.min_by("left", "rank").alias("pivot_left"), F.count("*").alias("members")).where("members > 1")
    pairs = rows.join(heads, "key").where(f"node <> pivot AND {_ENOUGH.format(percent)}")
    known = materialize(_distances(pairs.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct(), sets))
    comps, level, most = _linked(known, None, percent), 0, FIRST_PIVOTS
    discard(known)
    while True:
        live = materialize(_open(_with_components(rows, comps)))
        discard(rows)
        if live.isEmpty():
            discard(live)
            discard(sets)
            return comps
        order = Window.partitionBy("key").orderBy("rank", "node")
        pivots = live.where("active").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1)
        full = pivots.groupBy("key").agg((F.max("r") > most).alias("more"))
        pivots = pivots.where(F.col("r") <= most).select("key", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("left").alias("pivot_left"), F.col("before").alias("pivot_before"), F.col("comp").alias("pivot_comp"), F.col("edges").alias("pivot_edges"), (F.col("r") <= CELL_PIVOTS).alias("center"))
        pivots = materialize(pivots.join(full, "key").withColumn("center", F.col("center") & F.col("more")))
        more = pivots.where("more").select("key").distinct()
        # only pairs that can still join two components count, and two sets that have a region before this one in common have met in that one;
        # where active sets are left over, all distances to some pivots make the cells
        needed = f"comp <> pivot_comp AND (edges & pivot_edges) = 0 AND NOT arrays_overlap(before, pivot_before) AND {_ENOUGH.format(percent)}"
        needed = f"node <> pivot AND (center OR ({needed}))"
        pairs = materialize(live.select("key", "node", "n", "left", "before", "comp", "edges").join(pivots, "key").where(needed).select("key", "node", "pivot", "center"))
        u, v = F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")
        known = materialize(_distances(pairs.select(u, v).distinct(), sets))
        comps = _linked(known, comps, percent)
        if more.isEmpty():
            for table in (live, pivots, pairs, known, sets):
                discard(table)
            return comps
        near = pairs.where("center").join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").withColumns({"u": u, "v": v}).join(known, ["u", "v"])
        near = near.select("key", "node", "pivot", (1 - F.col("both") / F.col("either")).alias("away"))
        rows = _cells(live.join(more, "key", "left_semi"), near, level, radius)
        for table in (live, pivots, pairs, known):
            discard(table)
        most, level = min(4 * most, MOST_PIVOTS), level + 1


def jaccard_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links lead to) for every document.

    Cases: A-Z count as a-z; a text of fewer than k words is one shingle; null or empty texts have no shingles, link
    with nothing and are their own component; equal texts are one point and share its component; very long texts are one set
    like others; repeated ids and rows are all returned, and different texts under one id are points of their own; rows without
    an id take part through their copies only; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = materialize(slim.mapInArrow(_name_job(k), "doc_id long, n long, k1 long, k2 long"))
    points = named.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("sid"))
    points = materialize(points.withColumn("node", F.monotonically_increasing_id()))  # written, so that the numbers stay
    thirds = slim.mapInArrow(_third_job(k), "h long, k1 long")
    only = thirds.groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("hi")).where("k1 = hi").groupBy("k1").agg(F.count("*").alias("alone"))
    left = points.join(only, "k1", "left").where(F.coalesce("alone", F.lit(0)) <= _most_alone("n", percent)).where("sid IS NOT NULL")
    left = materialize(left.select("node", F.col("sid").alias("doc_id"), "k1", "k2"))
    sets = materialize(slim.join(left, "doc_id").mapInArrow(_set_job(k), "node long, n long, set array<long>"))
    comps = link_components(_peeled(sets, percent), percent)
    if comps is not None:
        joined = points.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("sid").alias("least"))
        points = materialize(joined.join(least, "component").select("n", "k1", "k2", F.col("least").alias("sid")))
    full = named.where("n > 0").join(points, ["n", "k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("component_id"))
    empty = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents over all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
