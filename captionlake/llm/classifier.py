"""Quality classifier: a factorisation machine over hashed words and structure statistics of a text.

score = sigmoid(bias + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j), where the pair sum is taken in linear time as half of
|sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Fitted by AdaGrad on a bounded sample of labelled rows; every row is scored.
Inputs come from the text alone: neither labels nor language, source or id. The number of epochs and the rate are chosen by the loss on
one of the training folds, left out of a first fit; the held-out fold takes no part in that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from captionlake.llm.bytewords import Chunk, chunks, mix, row_of

HASHED = 1 << 15
RANK = 8
#: At most so many labelled rows (in expectation) fit the model; fewer where there are fewer.
TRAINING_ROWS = 6_000
#: Settings that the validation fold chooses from: rates, and after how many epochs to stop.
RATES = (0.05, 0.15)
MOST_EPOCHS = 12
BATCH = 64
THRESHOLD = 0.3
FOLDS = 5
#: Of the folds that may be learned from, the one that chooses the settings.
VALIDATION_FOLD = 1
#: Structure statistics of a text, each scaled to about 0..1.
STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "bars", "marks", "shouts", "repeats", "line_words", "repeated_lines", "high_bytes", "empty")

_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in "#*$%&<>@^~=+_\\/{}[]"]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[ord("|")] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[0x80:] = 7


def _statistics(c: Chunk, first: np.ndarray, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    n = np.diff(first)
    some = np.maximum(n, 1)
    solid = np.maximum(c.per_row(~c.space), 1)
    kind = _CLASS[c.data]
    share = [c.per_row(kind == k) / solid for k in range(1, 8)]
    key = np.unique(mix(words + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]
    distinct = np.bincount(rows[key], minlength=c.rows)
    ls, le, lfirst = c.lines()
    lrow = row_of(lfirst)
    full = le > ls
    at = np.unique(mix(c.hashes(ls[full], le[full]) + lrow[full].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]
    lines = np.bincount(lrow[full], minlength=c.rows)
    repeated = lines - np.bincount(lrow[full][at], minlength=c.rows)
    symbols, capitals, digits, bars, marks, shouts, high = share
    columns = (
        np.log1p(n) / 10, np.minimum(solid / some / 12, 2), np.sqrt(symbols), np.sqrt(capitals), np.sqrt(digits), np.sqrt(bars), np.sqrt(marks), np.sqrt(shouts),
        1 - distinct / some, np.log1p(some / np.maximum(lines, 1)) / 6, repeated / np.maximum(lines, 1), np.sqrt(high), (n == 0).astype(float),
    )
    return np.stack(columns, axis=1)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (first row, rows, row, feature, value), ordered by row: statistics first, then hashed words.

    A word's value is 1 over the root of the text's number of distinct hashed words, so long texts weigh like short ones.
    """
    d = len(STATISTICS)
    for c in chunks(column):
        start, end, first = c.words()
        words, rows = c.hashes(start, end), row_of(first)
        stats = _statistics(c, first, words, rows)
        key = np.unique(rows * HASHED + (words % np.uint64(HASHED)).astype(np.int64))
        wrow, bucket = key // HASHED, key % HASHED
        weight = 1 / np.sqrt(np.maximum(np.bincount(wrow, minlength=c.rows), 1))
        row = np.concatenate([np.repeat(np.arange(c.rows), d), wrow])
        feature = np.concatenate([np.tile(np.arange(d), c.rows), bucket + d])
        value = np.concatenate([stats.reshape(-1), weight[wrow]])
        order = np.argsort(row, kind="stable")
        yield c.lo, c.rows, row[order], feature[order], value[order]


class FactorisationMachine:
    """Weights of a rank-RANK machine; fit() by AdaGrad on logistic loss, score() in linear time."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 3):
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def _sums(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linear = np.add.reduceat(self.w[feature] * value, first)
        part = self.v[feature] * value[:, None]
        sums = np.add.reduceat(part, first, axis=0)
        pairs = 0.5 * (np.square(sums).sum(axis=1) - np.add.reduceat(np.square(part).sum(axis=1), first))
        return self.bias + linear + pairs, sums

    def score(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has its statistics, so none is without a feature."""
        first = np.searchsorted(row, np.arange(rows))
        total, _ = self._sums(first, feature, value)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float, epochs: int, seed: int = 5) -> Iterator[None]:
        """Learn from examples (features, values); yields after each epoch."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for lo in range(0, len(order), BATCH):
                ids = order[lo : lo + BATCH]
                feature, value, size, first = _together([examples[i] for i in ids])
                total, sums = self._sums(first, feature, value)
                slope = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[ids]) / len(ids)
                each = np.repeat(slope, size)
                used, at = np.unique(feature, return_inverse=True)
                dw = np.bincount(at, weights=each * value, minlength=len(used)) + 1e-6 * self.w[used]
                grad = (each * value)[:, None] * (np.repeat(sums, size, axis=0) - self.v[feature] * value[:, None])
                by = np.argsort(at, kind="stable")
                dv = np.add.reduceat(grad[by], np.searchsorted(at[by], np.arange(len(used))), axis=0) + 1e-5 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += slope.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
                self.bias -= rate * slope.sum() / np.sqrt(gb)
            yield

    def loss(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> float:
        """Mean logistic loss."""
        total = 0.0
        for lo in range(0, len(examples), 256):
            feature, value, _, first = _together(examples[lo : lo + 256])
            score = np.clip(self._sums(first, feature, value)[0], -30, 30)
            total += np.logaddexp(0, np.where(labels[lo : lo + 256] > 0.5, -score, score)).sum()
        return total / len(examples)


def _together(examples: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and values of some examples in one array each, their numbers and first places."""
    size = np.array([len(f) for f, _ in examples])
    return np.concatenate([f for f, _ in examples]), np.concatenate([v for _, v in examples]), size, np.append(0, np.cumsum(size)[:-1])


def fitted(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, validation: np.ndarray) -> FactorisationMachine:
    """A machine fitted on all examples, with the rate and number of epochs of least loss on the validation ones when fitted on the others."""
    size = len(STATISTICS) + HASHED
    inner, outer = np.flatnonzero(~validation), np.flatnonzero(validation)
    best = (np.inf, RATES[0], MOST_EPOCHS // 2)  # where one part is empty
    if len(inner) and len(outer):
        left_out = [examples[i] for i in outer]
        for rate in RATES:
            machine = FactorisationMachine(size)
            for epoch, _ in enumerate(machine.fit([examples[i] for i in inner], labels[inner], rate, MOST_EPOCHS)):
                best = min(best, (machine.loss(left_out, labels[outer]), rate, epoch + 1))
    machine = FactorisationMachine(size)
    for _ in machine.fit(examples, labels, best[1], best[2]):
        pass
    return machine


def fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> F.Column:
    return fold(id_col) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Fit on labelled rows outside the held-out fold: those with the least hash of the id, at most ``rows``.

    Without labelled rows the machine scores about 0.5 for every text. Of rows that share an id, or labels that do, each counts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.withColumn("fold", fold("doc_id")).where("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # the chosen ids are at most ``rows`` and go to the documents, which stay where they are
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, n, row, feature, value in features(batch.column("text")):
                edges = np.searchsorted(row, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, t)) for x, t in ((feature, pa.int32()), (value, pa.float32()))]
                fixed = [pa.array(ids[lo : lo + n]), pa.array(label[lo : lo + n]), batch.column("fold").slice(lo, n)]
                yield pa.RecordBatch.from_arrays([*fixed, *lists], names=["doc_id", "label", "fold", "feature", "value"])
        pa.default_memory_pool().release_unused()

    kind = texts.schema["doc_id"].dataType.simpleString()
    sample = texts.mapInArrow(job, f"doc_id {kind}, label double, fold long, feature array<int>, value array<float>").toArrow()
    if sample.num_rows:
        ids = sample.column("doc_id").to_numpy()
        order = np.lexsort((sample.column("label").to_numpy(), ids))
        pick = sample.take(pa.array(order)).combine_chunks()
        f, v = pick.column("feature").combine_chunks(), pick.column("value").combine_chunks()
        edges = f.offsets.to_numpy()
        ff, vv = f.values.to_numpy(), v.values.to_numpy().astype(float)
        examples = [(ff[a:b], vv[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return fitted(examples, pick.column("label").to_numpy(), pick.column("fold").to_numpy() == VALIDATION_FOLD)
    return FactorisationMachine(len(STATISTICS) + HASHED)


def _score_job(shared, text_col: str, score_col: str):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            scores = [machine.score(n, row, feature, value) for _, n, row, feature, value in features(batch.column(text_col))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.round(9))], names=[*batch.schema.names, score_col])
        pa.default_memory_pool().release_unused()  # the worker stays for later jobs; its free memory should not

    return job


def score_quality(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs with a score (0 to 1, higher: good quality likelier). Null texts score like empty ones; all rows stay.

    All columns stay, whatever their names; a column that is named like the score is replaced by it.
    """
    docs = docs.drop(score_col)
    machine.v, machine.w = machine.v.astype(np.float32), machine.w.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: HASHED * (RANK + 1) numbers
    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())
    return docs.mapInArrow(_score_job(shared, text_col, score_col), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Cases: null and empty texts get the score of an empty text; equal texts get equal scores, whatever the row; a very long text is
    scored whole; repeated rows and ids are scored one by one; rows without an id are scored and not held out; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_quality(slim, train(slim, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
