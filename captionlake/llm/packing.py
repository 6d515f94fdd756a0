"""Packing by cutting-stock column generation.

Documents are tokenised and cut into full pieces of CAPACITY ids and one remainder. The histogram of piece lengths, in
classes of GRAIN ids (a fixed number of classes, whatever the corpus), is the demand of a cutting-stock problem: a linear
program over patterns (how many pieces of each class fill one sequence) whose columns are priced by an unbounded knapsack
until its value is proven to be within GAP of the least.
The fractional solution is rounded down, what is left is filled greedily, and the pieces, ranked inside their class, are
dealt to the patterns' places. Only the histogram and the patterns pass through the driver.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.llm.tables import materialize

CAPACITY = 2048
GRAIN = 8
END_ID = 1
#: The program stops when its value is proven to be within this part of the least.
GAP = 5e-4
#: Weight of the best dual values so far, against the program's own, in the prices of a round.
SMOOTHING = 0.8
#: Pieces of one class that one task ranks.
ROWS_PER_CELL = 50_000
#: Words whose ids a worker keeps: a cache of some 50 MB, which stays beside the executor's heap until the worker ends. Frequent words are soon back after it is emptied.
KEPT_WORDS = 100_000
#: Characters of the texts that are encoded together (a longer text is taken whole).
PORTION = 1 << 18
#: Letters, digits and marks that both libraries split alike: Latin ones and line feeds.
_PLAIN = re.compile("[\\n\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: A space before white space or the text's end.
_GAP = re.compile(r" (?=\s|\Z)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct word of a batch once.

    The vocabulary's own split never joins a space to what stands before it, if the character after the space is no
    white space: cutting there leaves all ids as they are. Texts with other runs of white space after a space go to the library
    whole. With ``ranks``, the same vocabulary as a rank file, plain Latin words are merged by tiktoken, which gives the same ids
    for a quarter of the time; all others stay with tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.plain = _rank_encoding(ranks) if ranks else None

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}

    def _bytes(self, parts: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        rest = parts
        if self.plain:
            encode, rest = self.plain.encode_ordinary, []
            for p in parts:
                if "<|" in p or not _PLAIN.fullmatch(p):
                    rest.append(p)
                else:
                    ids = encode(p)
                    out[p] = _PACK[len(ids)](*ids) if len(ids) < 16 else np.array(ids, "<u4").tobytes()
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, found, strict=True))
        return [out[p] for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, split, out, whole = self.known, [], [b""] * len(texts), []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if _GAP.search(text):
                whole.append(i)
            else:
                head, *parts = text.split(" ")
                split.append((i, head, parts))
                missing.update(set(parts).difference(known))
        new = list(missing)
        known.update(zip(new, self._bytes([f" {p}" for p in new]), strict=True))
        heads = self._bytes([head for _, head, _ in split])
        for (i, _, parts), ids in zip(split, heads, strict=True):
            out[i] = ids + b"".join(map(known.__getitem__, parts))
        for i, ids in zip(whole, self._bytes([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None) -> WordEncoder:
    """A worker's encoder: its words stay known from one task to the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, ranks)


def _pieces_job(path: str, ranks: str | None, capacity: int, with_ids: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:], dtype=np.int64), PORTION)))
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(encoder.encode(texts)):
                    data += end
                    n = len(data) // 4
                    for at in range(0, n, capacity):
                        part = data[4 * at : 4 * (at + capacity)]
                        row.append(lo + i)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        ids.append(part if with_ids else None)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                columns = [batch.column("doc_id").take(pa.array(row))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)
                lo = hi
        pa.default_memory_pool().release_unused()  # the worker stays for later jobs; its free memory should not

    return job


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids: doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian 32-bit).

    A null text is empty; every document ends in END_ID, so an empty one is a piece of one id.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    ranks = None if path else ranks_path()
    return slim.mapInArrow(_pieces_job(path or vocabulary_path(), ranks, capacity, with_ids), schema)


def knapsack(values: np.ndarray, units: int) -> np.ndarray:
    """Counts of classes 1..len(values) (class c takes c units) of most value within ``units``."""
    m = len(values)
    best, pick = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        top = min(m, room)
        options = values[:top] + best[room - 1 :: -1][:top]
        c = int(np.argmax(options))
        if options[c] > best[room - 1] + 1e-12:
            best[room], pick[room] = options[c], c + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(m, np.int64), units
    while room > 0:
        if pick[room]:
            counts[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return counts


@dataclass
class Cutting:
    """patterns (pieces of each class, how many sequences they fill), the linear program's value and a proven lower bound of it."""

    patterns: list[tuple[np.ndarray, int]]
    value: float = 0.0
    bound: float = 0.0

    @property
    def gap(self) -> float:
        """How far the value can be above the least, as a part of the least."""
        return self.value / self.bound - 1 if self.bound else 0.0


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps with row pivots, in plain array arithmetic: no threaded library runs beside the session."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for i in range(n):
        top = i + int(np.abs(work[i:, i]).argmax())
        if top != i:
            work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def _greedy(left: np.ndarray, sizes: np.ndarray, units: int) -> Iterator[tuple[np.ndarray, int]]:
    """Patterns that fill sequences with the longest pieces that still fit, and how often each is used, until nothing is left."""
    left = left.copy()
    while left.any():
        room, counts = units, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            take = min(int(left[i]), room // int(sizes[i]))
            counts[i] += take
            room -= take * int(sizes[i])
        used = counts > 0
        times = max(1, int((left[used] // counts[used]).min()))
        left = np.maximum(left - counts * times, 0)
        yield counts, times


class _Program:
    """Least number of sequences such that patterns hold the demand: the revised simplex, one column at a time."""

    def __init__(self, sizes: np.ndarray, need: np.ndarray, units: int):
        fill = units // sizes
        self.need, self.columns = need, np.diag(fill)
        self.inverse, self.amount, self.turns = np.diag(1.0 / fill), need / fill, 0

    def duals(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def enter(self, new: np.ndarray) -> None:
        """Swap a column in for the one that runs out first."""
        step = (self.inverse * new).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, self.amount / step, np.inf)
        out = int(np.argmin(ratio))
        self.columns[:, out] = new
        self.turns += 1
        if self.turns % 200 == 0:  # rounding errors of the updates don't pile up
            self.inverse = _inverse(self.columns.astype(float))
            self.amount = np.maximum((self.inverse * self.need).sum(axis=1), 0.0)
        else:
            move = ratio[out]
            self.amount = np.maximum(self.amount - move * step, 0.0)
            self.amount[out] = move
            row = self.inverse[out] / step[out]
            self.inverse -= step[:, None] * row
            self.inverse[out] = row


def cutting_plan(demand: np.ndarray, units: int, gap: float = GAP) -> Cutting:
    """Patterns that cover the demand of every class (class c takes c units), by column generation.

    Columns are priced by the knapsack over smoothed dual values: mostly those of the best bound so far, to which the pieces' own lengths
    are the start (they are feasible duals, and the total length is their bound). Any prices divided by the value of their best pattern
    are feasible duals, so each round proves a bound. The program ends when its value is within ``gap`` of the best bound, or
    when no pattern is worth more than a sequence at its own duals, which proves the optimum.
    """
    active = np.flatnonzero(demand)
    if not len(active):
        return Cutting([])
    sizes = active + 1
    need = demand[active].astype(float)
    program = _Program(sizes, need, units)
    best = sizes / units
    bound = float((best * need).sum())

    def worth(counts: np.ndarray, prices: np.ndarray) -> float:
        return float((counts * prices).sum())

    def price(prices: np.ndarray) -> np.ndarray:
        """The pattern worth most; the prices become the best ones where they prove more."""
        nonlocal best, bound
        values = np.zeros(units)
        values[active] = prices
        counts = knapsack(values, units)[active]
        if (top := worth(counts, prices)) > 0 and (proven := worth(need, prices) / top) > bound:
            best, bound = prices / top, proven
        return counts

    for counts, _ in _greedy(demand[active], sizes, units):
        if worth(counts, program.duals()) > 1 + 1e-9:
            program.enter(counts)
    while program.amount.sum() > bound * (1 + gap):
        duals = program.duals()
        new = price(SMOOTHING * best + (1 - SMOOTHING) * np.maximum(duals, 0.0))
        if worth(new, duals) <= 1 + 1e-9:
            new = price(np.maximum(duals, 0.0))
            if worth(new, duals) <= 1 + 1e-9:
                break
        program.enter(new)
    left = demand[active].copy()
    found: list[tuple[np.ndarray, int]] = []

    def use(counts: np.ndarray, times: int) -> None:
        nonlocal left
        wide = np.zeros(units, np.int64)
        wide[active] = counts
        found.append((wide, times))
        left = np.maximum(left - counts * times, 0)

    for counts, x in zip(program.columns.T, program.amount, strict=True):
        if (times := int(x + 1e-6)) > 0:
            # never more places than pieces: a pattern is used as often as it is filled
            used = counts > 0
            times = min(times, int((left[used] // counts[used]).min()))
            if times > 0:
                use(counts, times)
    for counts, times in list(_greedy(left, sizes, units)):  # the few pieces that rounding left
        use(counts, times)
    return Cutting(found, float(program.amount.sum()), min(bound, float(program.amount.sum())))


def cutting_patterns(demand: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """The patterns of cutting_plan()."""
    return cutting_plan(demand, units).patterns


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """Number the pieces (row, cls) of every class from 0: inside cells of a hash, plus the counts of the cells before."""
    cells = max(1, -(-total // ROWS_PER_CELL))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row.doc_id", "row.start"), F.lit(cells)))
    counts = rows.groupBy("cls", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cls").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("cls", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cls", "cell").orderBy("row.doc_id", "row.start", "row.ids_crc32")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["cls", "cell"])
    return rows.select("row", "cls", (F.col("rank") + F.col("before")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add sequence_id and offset (gapless from 0 inside a sequence) to pieces of at most ``capacity`` ids.

    pieces: doc_id, start, length, ids_crc32 and any other columns, as token_pieces() gives them. Cases: equal pieces and repeated ids are
    packed one by one, ties in no particular order; a very long text is many full pieces; an empty table gives no rows; other columns
    stay, whatever their names, but columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rows = materialize(pieces.select(F.struct(*pieces.columns).alias("row"), F.expr(f"(length + {grain - 1}) div {grain}").alias("cls")))
    units = capacity // grain
    demand = np.zeros(units, np.int64)
    for r in rows.groupBy("cls").agg(F.count("*").alias("n")).collect():  # one row for each of ``units`` classes
        demand[r["cls"] - 1] = r["n"]
    places, sequence, upto = [], 0, np.zeros(units, np.int64)
    for counts, times in cutting_patterns(demand, units):
        slot = 0
        for c in range(units - 1, -1, -1):
            if counts[c]:
                places.append((c + 1, int(upto[c]), int(upto[c] + counts[c] * times), int(counts[c]), sequence, slot))
                upto[c] += counts[c] * times
                slot += int(counts[c])
        sequence += times
    # as an Arrow table, which needs no Python workers of its own on the executors
    columns = np.array(places, np.int64).reshape(-1, 6).T
    table = spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=["cls", "lo", "hi", "each", "base", "slot"]))
    # the places table has one row for each class of each pattern: its size depends on the number of classes only
    ranked = _ranked(rows, int(demand.sum())).alias("p")
    dealt = ranked.join(F.broadcast(table).alias("t"), F.expr("p.cls = t.cls AND p.rank >= t.lo AND p.rank < t.hi"))
    dealt = dealt.select("row", F.expr("t.base + (p.rank - t.lo) div t.each").alias("sequence_id"), F.expr("t.slot + (p.rank - t.lo) % t.each").alias("slot"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("offset", F.coalesce(F.sum("row.length").over(before), F.lit(0)))
    return placed.select("row.*", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
