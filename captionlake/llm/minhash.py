"""MinHash near-dedup with odd sketches.

1. Equal sets of word shingles are merged, so a group of copies is one node.
2. Each set gets BANDS * BAND_ROWS minima of as many hashes; BAND_ROWS of them make the key of a band. Two sets of similarity s share the key
   of a band with probability s ** BAND_ROWS, and none at all with (1 - s ** BAND_ROWS) ** BANDS: 5 in ten million at 0.85, less above.
3. Each set also gets an odd sketch (Mitzenmacher, Pagh and Pham, 2014): the minima of SAMPLES hash classes (one hash for each shingle, its
   first bits name the class), folded into a bitmap of SKETCH_BITS parities. The set bits of the XOR of two sketches estimate how many
   minima only one of the sets has, most precisely where that is few. Pairs whose estimate is too high for a link by six standard deviations
   leave; all others are confirmed on their full sets.
4. No bucket is turned into pairs. Its most central set (that of the largest buckets) is compared with the others first: nearly all near
   copies are in one component then, and a bucket whose sets are all in one is settled. In the others, sets outside of the central set's
   component become pivots, some for each bucket, and are compared by their sketches with all of it; pivots have met all others of their
   bucket and leave it. This goes on, with more pivots, until each bucket is settled. Only pairs that pass the sketches are emitted, each
   in the first of its common bands.

In step 4 the sets of a bucket stream past its pivots (a sort by bucket, pivots first), so a task holds the pivots of one bucket at a
time, and a large bucket is dealt over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.llm.bytewords import mix
from captionlake.llm.components import components
from captionlake.llm.jaccard import SHINGLE, _names, _set_job, shingle_sets
from captionlake.llm.tables import discard, materialize

#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS = 25
BAND_ROWS = 5
#: Hash classes of a sketch (a power of two), and its parities.
SAMPLES = 4096
SKETCH_BITS = 2048
#: Pivots of a bucket in the first round, and in later ones (what a task holds of one bucket, some 0.5 MB).
FIRST_PIVOTS = 256
MOST_PIVOTS = 1000
#: Rows of a bucket that one task compares with its pivots.
BUCKET_ROWS = 20_000
#: Standard deviations that an estimate may lie beyond the threshold.
DEVIATIONS = 6.0


def _multipliers(n: int) -> np.ndarray:
    """n odd 64-bit numbers; a product with one of them orders mixed hashes anew."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(edges: np.ndarray, h: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key a band for each set (h[edges[i]:edges[i + 1]], none of them empty)."""
    out = np.empty((len(edges) - 1, bands), np.uint64)
    factors = _multipliers(bands * rows).reshape(bands, rows)
    for b in range(bands):
        key = np.full(len(edges) - 1, b, np.uint64)
        for a in factors[b]:
            key = mix(key + np.minimum.reduceat(h * a, edges[:-1]) + np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = key
    return out.view(np.int64)


def odd_sketches(edges: np.ndarray, h: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps (rows of bits / 8 bytes) of the minima of each set's hash classes."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    again = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    order = np.lexsort((again, row))
    row, again = row[order], again[order]
    kind = (again >> np.uint64(64 - int(math.log2(samples)))).astype(np.int64)
    first = np.ones(len(row), bool)  # sorted by hash, a class begins with its minimum
    first[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])
    bit = (mix(again[first]) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(row[first] * bits + bit, minlength=(len(edges) - 1) * bits)
    return np.packbits((flips & 1).astype(bool).reshape(-1, bits), axis=1)


def most_differing(n: np.ndarray, m: np.ndarray, percent: int = PERCENT, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = DEVIATIONS) -> np.ndarray:
    """The most set bits that the XOR of the sketches of two linked sets of n and m shingles has.

    The union's minima are a sample, without replacement, of its shingles; one in a single set makes one sample that differs, or two where
    the other set has a minimum of its own in the class. Their number at the threshold (sets above it differ less), plus the deviations, gives
    the mean and the variance of the odd counts; there are never more odd counts than samples that differ.
    """
    s = percent / 100
    union = (n + m) / (1 + s)
    used = -samples * np.expm1(union * np.log1p(-1 / samples))
    mean = used * (1 - s)
    spread = used * s * (1 - s) * np.maximum(0.0, union - used) / np.maximum(union - 1, 1.0)
    both = -np.expm1(np.maximum(n, m) * np.log1p(-1 / samples))
    differ = mean * (1 + both) + deviations * np.sqrt(spread * (1 + both) ** 2 + mean * both * (1 - both))
    one, two = np.exp(differ * np.log1p(-2 / bits)), np.exp(differ * np.log1p(-4 / bits))
    odd = bits * (1 - one) / 2
    spread = np.maximum(0.0, bits * (1 - two) / 4 + bits * bits * (two - one * one) / 4)
    return np.minimum(np.ceil(differ), odd + deviations * np.sqrt(spread))


def _maybe(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with sketches a and b can link: by their sizes, then by their sketches."""
    near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return near & (np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= most_differing(n, m, percent))


def _signature_job(k: int, bands: int, rows: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, count, r, h in shingle_sets(batch.column("text"), k):
                n, k1, k2 = _names(count, r, h)
                solid = np.flatnonzero(n)
                keys, sketches = pa.nulls(count, pa.list_(pa.int64())), pa.nulls(count, pa.binary())
                if len(solid):
                    edges = np.append(0, np.cumsum(n[solid]))
                    at = np.full(count, -1)
                    at[solid] = np.arange(len(solid))
                    take = pa.array(at, mask=at < 0)
                    keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(edges, h, bands, rows).ravel()), bands).cast(pa.list_(pa.int64())).take(take)
                    sketches = pa.array([s.tobytes() for s in odd_sketches(edges, h)], pa.binary()).take(take)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, count), pa.array(n), pa.array(k1), pa.array(k2), keys, sketches], names=["doc_id", "n", "k1", "k2", "keys", "sketch"]
                )

    return job


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A matrix of the bytes of a binary column of one width."""
    if not len(column):
        return np.zeros((0, SKETCH_BITS // 64), np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _lists_of(column: pa.Array) -> np.ndarray:
    """A matrix of the numbers of a list column of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, BANDS), np.int64)


def _filter_job(percent: int):
    """Pairs (u, v, nu, nv, su, sv) whose sketches allow a link, as (u, v)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
            ok = _maybe(n, m, _bytes_of(batch.column("su")), _bytes_of(batch.column("sv")), percent)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok))

    return job


def _pivot_job(percent: int):
    """Rows in order of (key, salt, later): pivots first, then the sets that are compared with them; gives (u, v) of all that can link.

    A pair is left to the bucket of the first band in which both keys are the same.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the bucket that goes on in the next batch, with its pivots so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, node, comp, n = (batch.column(x).to_numpy() for x in ("key", "salt", "node", "comp", "n"))
            pivot = batch.column("later").to_numpy() == 0
            sketch, keys = _bytes_of(batch.column("sketch")), _lists_of(batch.column("keys"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            edges = np.append(np.flatnonzero(new), len(key))
            us, vs = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mid = lo + int(pivot[lo:hi].sum())
                own = (node[lo:mid], comp[lo:mid], n[lo:mid], sketch[lo:mid], keys[lo:mid])
                if held is not None and held[0] == (key[lo], salt[lo]):
                    own = tuple(np.concatenate([a, b]) for a, b in zip(held[1], own, strict=True))
                held = ((key[lo], salt[lo]), own)
                nodes, comps, sizes, sketches, bands = own
                if not len(nodes):
                    continue
                step = max(1, (1 << 18) // len(nodes))
                for at in range(mid, hi, step):  # sets of the bucket by pivots, some at a time
                    s = slice(at, min(at + step, hi))
                    apart = comp[s, None] != comps
                    i, j = np.nonzero(apart & (100 * np.minimum(n[s, None], sizes) >= percent * np.maximum(n[s, None], sizes)))
                    if len(i):
                        ok = _maybe(n[s][i], sizes[j], sketch[s][i], sketches[j], percent)
                        i, j = i[ok], j[ok]
                        mine, yours = keys[s][i], bands[j]
                        ok = mine[np.arange(len(i)), (mine == yours).argmax(axis=1)] == key[lo]
                        us.append(np.maximum(node[s][i[ok]], nodes[j[ok]]))
                        vs.append(np.minimum(node[s][i[ok]], nodes[j[ok]]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return job


class _Texts:
    """Confirms pairs on full sets, which are made anew from the texts."""

    def __init__(self, slim: DataFrame, points: DataFrame, k: int, percent: int):
        self.slim, self.points, self.k, self.percent = slim, points, k, percent

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the given nodes."""
        wanted = self.points.join(nodes, "node").select("node", F.col("sid").alias("doc_id"), "k1", "k2")
        sets = self.slim.join(wanted, "doc_id").mapInArrow(_set_job(self.k), "node long, n long, set array<long>")
        return materialize(sets.groupBy("node").agg(F.first("set").alias("set")))  # rows that repeat an id give a set more than once

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v) that link, by the sizes of the intersection and the union of their full sets."""
        a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in ("u", "v"))
        both = F.size(F.array_intersect("su", "sv"))
        links = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.size("su") + F.size("sv") - both).alias("either"))
        return materialize(links.where(f"100 * both >= {self.percent} * either").select("u", "v"))


def _joined(links: DataFrame, comps: DataFrame | None) -> DataFrame | None:
    """comps (node, component) with more links."""
    if links.isEmpty():
        return comps
    edges = links if comps is None else links.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return materialize(components(edges))


def _live(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows (key, node, rank) of buckets that hold more than one component, with comp, members and whether a set is outside of the main one."""
    if comps is None:
        rows = rows.withColumn("comp", F.col("node"))
    else:
        rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    alive = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", "rank").alias("main"), F.count("*").alias("members")).where("lo < hi")
    return rows.join(alive.select("key", "main", "members"), "key").withColumn("active", F.col("comp") != F.col("main")).drop("main")


def near_components(points: DataFrame, texts: _Texts, percent: int) -> DataFrame | None:
    """(node, component) for all points (node, n, keys, sketch) that link with another; None if none does."""
    every = points.select("node", F.explode("keys").alias("key"))
    sizes = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = materialize(every.join(sizes, "key"))
    central = rows.groupBy("node").agg(F.sum("members").alias("c")).select("node", F.struct("c", "node").alias("rank"))
    ranked = materialize(rows.select("key", "node").join(central, "node"))
    discard(rows)
    prints = points.select("node", "n", "sketch")
    heads = ranked.groupBy("key").agg(F.max("rank").alias("head"))
    pairs = ranked.join(heads, "key").where("node <> head.node").select(F.greatest("node", "head.node").alias("u"), F.least("node", "head.node").alias("v")).distinct()
    pairs = pairs.join(prints.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u")
    pairs = pairs.join(prints.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
    maybe = materialize(pairs.mapInArrow(_filter_job(percent), "u long, v long"))
    sets = texts.sets_of(maybe.select("u").unionByName(maybe.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "node"))
    links = texts.links(maybe, sets)
    comps = _joined(links, None)
    rows = materialize(ranked.join(heads, "key").where("node <> head.node").drop("head"))  # heads have met all others
    discard(links, maybe, sets, ranked)
    most, sets = FIRST_PIVOTS, None
    while True:
        live = materialize(_live(rows, comps))
        discard(rows)
        if live.isEmpty():
            discard(live, *([sets] if sets is not None else []))
            return comps
        if sets is None:  # later rounds' sets are among these
            sets = texts.sets_of(live.select("node").distinct())
        order = Window.partitionBy("key").orderBy(F.col("rank").desc())
        pivots = materialize(live.where("active").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("key", "node", "comp", "members"))
        deal = F.ceil(F.col("members") / BUCKET_ROWS).cast("int")
        first = pivots.select("key", F.explode(F.sequence(F.lit(0), deal - 1)).alias("salt"), F.lit(0).alias("later"), "node", "comp")
        # pivots are among the sets that they are compared with: a pair of two pivots is met twice, and made distinct below
        rest = live.select("key", F.pmod(F.xxhash64("node"), deal).cast("int").alias("salt"), F.lit(1).alias("later"), "node", "comp")
        both = first.unionByName(rest).join(points.select("node", "n", "sketch", "keys"), "node")
        met = both.repartition("key", "salt").sortWithinPartitions("key", "salt", "later").mapInArrow(_pivot_job(percent), "u long, v long")
        links = texts.links(met.distinct(), sets)
        before, comps = comps, _joined(links, comps)
        if before is not None and comps is not before:
            discard(before)
        rows = materialize(live.select("key", "node", "rank").join(pivots.select("key", "node"), ["key", "node"], "left_anti"))
        discard(links, live, pivots)
        most = MOST_PIVOTS


def minhash_dedup(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links lead to) and kept (doc_id is that least one) for every document.

    Other thresholds need other bands: a link of similarity s is missed with probability (1 - s ** band_rows) ** bands. Cases: A-Z count
    as a-z; a text of fewer than k words is one shingle; null or empty texts have no shingles, link with nothing and are their own
    component; equal texts are one node and share its component; very long texts are one set like others; repeated ids and rows are all
    returned, rows of one id with different texts are nodes of their own; rows without an id take part through their copies only, and
    kept is null there; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = slim.mapInArrow(_signature_job(k, bands, band_rows), "doc_id long, n long, k1 long, k2 long, keys array<long>, sketch binary")
    signed = materialize(signed)
    nodes = signed.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("sid"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    points = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))  # written, so that the numbers stay
    comps = near_components(points.where("sid IS NOT NULL"), _Texts(slim, points, k, percent), percent)
    names = points.select("node", "n", "k1", "k2", "sid")
    if comps is not None:
        joined = names.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("sid").alias("least"))
        names = joined.join(least, "component").select("n", "k1", "k2", F.col("least").alias("sid"))
    full = signed.where("n > 0").select("doc_id", "n", "k1", "k2").join(names.select("n", "k1", "k2", "sid"), ["n", "k1", "k2"])
    full = full.select("doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("component_id"))
    empty = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies (0.85 or more) over all documents, and the document that is kept of each."""
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
