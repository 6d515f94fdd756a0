"""Vector codes by ball k-means: each vector is cut into parts, and each part becomes the index of its nearest codebook entry.

Components are whole numbers (floor of SCALE times the component), so all distances, sums and ties are exact. The entries
of a part position are balls: an entry and the parts assigned to it, within a radius. A round of assignment needs few of the entries:

1. An entry's neighbours are those no farther from it than twice its radius. A part of the ball can't be nearer to any other
   entry (triangle inequality), so an entry without neighbours keeps all its parts.
2. Parts within half the way to the entry's nearest neighbour are its stable core: they stay, and no distance is computed.
3. The rest of the ball falls into rings: beyond half the way to the i-th nearest neighbour, up to half the way to the next one. A part
   in the i-th ring is compared with the i nearest neighbours only.

All comparisons are of squared whole numbers (a neighbour at squared distance D is skipped where D > 4 d, d being the part's own
squared distance), and equal distances go to the lower index, so the codes are those of a full search. A radius is the farthest part of
the last assignment plus what the entry has moved since, rounded up.

A round is one pass over the vectors and one merged sum for each entry: only entries, sums and radii (their number is a
parameter) meet on the driver. Vectors stay in their partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.tables import discard, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Squared distances of a whole vector stay below this, so that they and their sums fit a long; larger components count as not finite.
MOST_ERROR = 1 << 61
#: Keys that the rows of one label are spread over when the label's error is joined back.
SALTS = 64
#: Up to here all whole numbers are exact in double precision.
_EXACT = 1 << 53
#: Distances that one step of the search holds at once.
_BLOCK = 1 << 21


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the vectors with finite components only, as arrays of longs of a length that ``parts`` divides.

    The length is that of the first vector in order of id (zeros fill its last part); vectors of another length, without
    components, or with components whose squares could leave a long are dropped like those with missing ones.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # within these bounds 4 * length * x * x stays below MOST_ERROR; it also leaves out infinities, and a comparison with NaN is false or above it
    bound = F.sqrt(F.lit(float(MOST_ERROR)) / (4 * F.size("v"))) / scale
    sound = slim.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound)))
    first = sound.select("vec_id", F.size("v").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).collect()
    n = first[0]["n"] if first else parts
    zeros = F.array_repeat(F.lit(0).cast("long"), -n % parts)
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("long"))
    return sound.where(F.size("v") == n).select("vec_id", "label", F.concat(whole, zeros).alias("x"))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact: in doubles where these hold them, else in longs, some rows at a time."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < _EXACT:
        fx, fc = x.astype(float), c.astype(float)
        return ((fx * fx).sum(1)[:, None] + (fc * fc).sum(1) - 2.0 * (fx @ fc.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    step = max(1, _BLOCK // max(1, c.size))
    for lo in range(0, len(x), step):
        gap = x[lo : lo + step, None, :] - c[None]
        out[lo : lo + step] = (gap * gap).sum(2)
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c."""
    gap = x - c
    return (gap * gap).sum(1)


class Balls:
    """The entries of one part position with their neighbours in order of distance; radii: whole numbers, or None where nothing is assigned yet."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray | None):
        self.entries = entries
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        if radii is None:
            return
        between = _between(entries)
        index = np.arange(len(entries))
        for i, r in enumerate(radii.tolist()):
            reach = between[i] <= min(4 * r * r, (1 << 63) - 1)
            reach[i] = False
            order = np.lexsort((index[reach], between[i][reach]))
            self.near.append((index[reach][order], between[i][reach][order]))

    def assign(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the lower index) of each row of x and its squared distance. before: the entries of the last round."""
        if before is None:
            return self._search(x, np.arange(len(self.entries)))
        best, away = before.copy(), _squares(x, self.entries[before])
        order = np.argsort(before, kind="stable")
        edges = np.searchsorted(before[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            near, gaps = self.near[i]
            if not len(near):
                continue  # no neighbour: all parts stay
            own = order[edges[i] : edges[i + 1]]
            ring = np.searchsorted(gaps, 4 * away[own], side="right")  # 0: the stable core
            # rings are taken together up to the next power of two: some entries more, never fewer
            width = np.minimum(len(near), 1 << np.ceil(np.log2(np.maximum(ring, 1))).astype(np.int64))
            for many in np.unique(width[ring > 0]):
                rows = own[(width == many) & (ring > 0)]
                found, gap = self._search(x[rows], np.sort(np.append(near[:many], i)))
                best[rows], away[rows] = found, gap
        return best, away

    def _search(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, away = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, _BLOCK // max(1, len(among)))
        for lo in range(0, len(x), step):
            d = _distances(x[lo : lo + step], self.entries[among])
            pick = d.argmin(1)  # the first of equal ones, and among is in order
            best[lo : lo + step], away[lo : lo + step] = among[pick], d[np.arange(len(d)), pick]
        return best, away


def _between(entries: np.ndarray) -> np.ndarray:
    return _distances(entries, entries)


def _rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def _assign_job(books: list[np.ndarray], radii: list[np.ndarray] | None):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None
        for batch in batches:
            if not batch.num_rows:
                continue
            balls = balls or [Balls(b, radii[p] if radii else None) for p, b in enumerate(books)]
            x = _rows_of(batch.column("x"))
            before = _rows_of(batch.column("entry")) if radii else None
            entry, away = [], []
            for p, (part, ball) in enumerate(zip(np.split(x, len(books), axis=1), balls, strict=True)):
                e, d = ball.assign(part, before[:, p] if before is not None else None)
                entry.append(e)
                away.append(d)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(v, 1).ravel()), len(books)).cast(pa.list_(pa.int64())) for v in (entry, away)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), *lists], names=["vec_id", "label", "x", "entry", "away"])

    return job


def _sum_job(parts: int, entries: int):
    """For each part position and entry that a task has seen: how many parts, their componentwise sums, the largest squared distance."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sums = far = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, entry, away = (_rows_of(batch.column(c)) for c in ("x", "entry", "away"))
            if n is None:
                n, far = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
                sums = np.zeros((parts, entries, x.shape[1] // parts), object)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                n[p] += np.bincount(entry[:, p], minlength=entries)
                np.maximum.at(far[p], entry[:, p], away[:, p])
                order = np.argsort(entry[:, p], kind="stable")
                used, first = np.unique(entry[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(part[order], first, axis=0)  # of one batch: far within a long
        if n is not None:
            at = np.argwhere(n > 0)
            columns = [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n[n > 0]), pa.array(far[n > 0]), pa.array([list(map(str, s)) for s in sums[n > 0]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "far", "sums"])

    return job


def _moved(books: list[np.ndarray], points: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The entries at the floored means of their parts (unused ones stay), and whole-number radii that hold all their parts."""
    parts, (entries, width) = len(books), books[0].shape
    sums = points.select("x", "entry", "away").mapInArrow(_sum_job(parts, entries), "part long, entry long, n long, far long, sums array<string>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *total)
    new, radii = [b.copy() for b in books], [np.zeros(entries, object) for _ in books]
    for r in merged.collect():  # parts * entries rows at most, whatever the number of vectors
        p, e = r["part"], r["entry"]
        new[p][e] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        shift = int(_squares(new[p][e : e + 1], books[p][e : e + 1])[0])
        radii[p][e] = math.isqrt(r["far"]) + 1 + math.isqrt(shift) + 1
    return new, radii


def digest_of(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, entry, away) for points (vec_id, label, x), and the final codebooks, one array of entries for each part position.

    entry and away hold, by part position, the index of the nearest entry and the squared distance to it.
    """
    points = materialize(points)
    start = points.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if not start:
        nothing = points.select("vec_id", "label", F.lit(None).cast("array<long>").alias("entry"), F.lit(None).cast("array<long>").alias("away"))
        return nothing, [np.zeros((0, 0), np.int64)] * parts
    books = np.split(np.array([r["x"] for r in start], np.int64), parts, axis=1)
    schema = f"vec_id long, label {points.schema['label'].dataType.simpleString()}, x array<long>, entry array<long>, away array<long>"
    radii = None
    for turn in range(rounds + 1):
        after = materialize(points.mapInArrow(_assign_job(books, radii), schema))
        discard(points)
        points = after
        if turn < rounds:
            books, radii = _moved(books, points)
    return points.select("vec_id", "label", "entry", "away"), books


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every vector that is kept (see whole_vectors).

    Cases: null vectors and null, NaN or infinite components drop the row, as do other lengths; rows that repeat an id or a vector are all
    coded, alike; rows without an id are coded but start no entry before those with one; of fewer vectors than entries each starts one; equal
    entries: the lower index; very long vectors are parts of more components; null labels are one label; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    points, books = vector_codes(whole_vectors(vectors, id_col, vector_col, label_col, parts, scale), parts, entries, rounds)
    code = F.lower(F.array_join(F.transform("entry", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    rows = points.select("vec_id", "label", code.alias("code"), F.aggregate("away", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, salted["label"].eqNullSafe(totals["_label"]) & (salted["salt"] == totals["_salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts, 256 entries each, 4 rounds."""
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
