"""Fill-in-middle by secondary sort: documents travel as pieces of some units, and sorting puts them together.

A unit is a word with the white space before it (or the white space at the end). Two cuts between units, drawn from a digest of the
document's id, make prefix, middle and suffix; the form says in which order they are written, each behind its mark. No task holds a
document twice over or rebuilds it from a grouped list:

1. Each document is emitted as pieces of at most PIECE_UNITS units of one part, keyed by the document and the place in the output.
2. repartitionAndSortWithinPartitions brings a document's pieces together in output order. They stream through one incremental digest;
   each piece is passed on with the place that it has in the text, which is read off the marks in the stream.
3. The same call with the same partitioning sorts the pieces again by that place (no second shuffle), and they stream through a second digest: the
   restored text.

The key holds a digest of id and text and the number of the task that read the row, so equal rows of one task share a key and are
counted (their pieces are neighbours in the sort), and a row that makes up a third of the table is spread over all reading tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
RATE = 50
SPM_RATE = 80
#: Units of one piece.
PIECE_UNITS = 2048
#: Bytes of text that one task sorts: they stay in the memory of its worker.
TASK_BYTES = 64 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The parts in the order of each form; a plain text has one part without a mark.
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Where each part stands in the text.
_PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2, b"": 0}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: bytes) -> np.ndarray:
    """Where each unit ends, in bytes: after each word, and at the end of white space that no word follows."""
    if not data:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The four numbers of a document: the first four groups of eight digits of the digest of seed and id (no digits for a null id)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def layout(doc_id: int | None, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, np.ndarray, int, int]:
    """Form, unit ends, and how many units stand before the middle and before the suffix."""
    ends = unit_ends(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain", ends, 0, len(ends)
    return "spm" if h4 % 100 < spm_rate else "psm", ends, a, b


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def pieces_of(doc_id: int | None, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, size: int = PIECE_UNITS) -> Iterator[tuple]:
    """The pieces of a document in output order: (bytes, facts); the first one carries (n, form, prefix_chars, middle_chars), others None."""
    form, ends, a, b = layout(doc_id, data, seed, rate, spm_rate)
    edge = np.append(0, ends)
    facts: tuple | None = (len(ends), form, None, None)
    if form == "plain":
        parts = [(b"", 0, len(ends))]
    else:
        spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(ends))}
        facts = (len(ends), form, _points(data[: edge[a]]), _points(data[edge[a] : edge[b]]))
        parts = [(mark, *spans[mark]) for mark in _ORDER[form]]
    for mark, lo, hi in parts:
        at = lo
        while True:
            to = min(at + size, hi)
            yield mark + data[edge[at] : edge[to]], facts
            facts, mark, at = None, b"", to
            if at >= hi:
                break


def _key_hash(key: tuple) -> int:
    """The partitioner: pieces of a document stay together, whatever their places."""
    return key[0]


def _emit_job(names: tuple[str, str], seed: int, rate: int, spm_rate: int, size: int):
    id_col, text_col = names

    def job(rows: Iterable) -> Iterator[tuple]:
        task = TaskContext.get().partitionId()
        for row in rows:
            doc_id, data = row[id_col], (row[text_col] or "").encode()
            name = hashlib.blake2b(data, digest_size=16, key=f"{doc_id}".encode()).digest()
            spread = int.from_bytes(hashlib.blake2b(name + task.to_bytes(8, "little"), digest_size=7).digest(), "little")
            for place, (piece, facts) in enumerate(pieces_of(doc_id, data, seed, rate, spm_rate, size)):
                yield (spread, name, task, place), (piece, (doc_id, *facts) if facts else None)

    return job


def _documents(rows: Iterable) -> Iterator[tuple[tuple, Iterator[tuple[bytes, tuple | None, int]]]]:
    """Sorted pieces by document: (key, stream); the stream gives each place's piece once, with how many equal rows have it."""
    rows = iter(rows)
    ahead = next(rows, None)

    def places(doc: tuple) -> Iterator[tuple[bytes, object, int]]:
        nonlocal ahead
        while ahead is not None and ahead[0][:3] == doc:
            (*_, place), (piece, more) = ahead
            copies = 0
            while ahead is not None and ahead[0][:3] == doc and ahead[0][3] == place:
                copies += 1
                ahead = next(rows, None)
            yield piece, more, copies

    while ahead is not None:
        doc = ahead[0][:3]
        yield doc, places(doc)


def part_of(piece: bytes, form: str) -> bytes | None:
    """The mark at the head of a piece of a written document (a text with a mark of its own is always plain)."""
    if form == "plain":
        return None
    return piece[:3] if piece[:3] in (PREFIX, SUFFIX, MIDDLE) else None


def _assemble_job(rows: Iterable) -> Iterator[tuple]:
    """Digest of each document's output; its pieces, without marks, go on with their place in the text."""
    for doc, stream in _documents(rows):
        digest, part, form, at, result, many = hashlib.sha256(), b"", "", 0, None, 0
        for piece, facts, copies in stream:
            if facts:
                result, form, many = facts, facts[2], copies
            digest.update(piece)
            if (mark := part_of(piece, form)) is not None:
                part, piece, at = mark, piece[3:], 0
            yield (*doc, (_PLACE[part], at)), (piece, None)
            at += 1
        # behind all pieces: what is known of the document, for each of its equal rows
        yield (*doc, (3, 0)), (b"", (*result, digest.hexdigest(), many))


def _restore_job(rows: Iterable) -> Iterator[tuple]:
    """Digest of each document's pieces in the order of the text."""
    for _, stream in _documents(rows):
        digest = hashlib.sha256()
        for piece, facts, _ in stream:
            digest.update(piece)
            if facts:
                *result, many = facts
                yield from [(*result, digest.hexdigest())] * many


def fill_in_middle_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, piece_units: int = PIECE_UNITS, partitions: int | None = None
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document.

    rate and spm_rate: per cent of documents that are transformed, and of these in the form spm; partitions: by default as many as leave
    each task TASK_BYTES of text, by a sum over the table before. Cases: a null text is an empty one, which is
    plain; a text with a mark in it is plain; rows that repeat an id, or id and text, are all returned; an id of null draws from the seed alone; a
    very long text is many pieces, of which a task holds one at a time beside the row it reads; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    many = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES))
    pieces = slim.rdd.mapPartitions(_emit_job(("doc_id", "text"), seed, rate, spm_rate, piece_units))
    written = pieces.repartitionAndSortWithinPartitions(many, _key_hash).mapPartitions(_assemble_job, preservesPartitioning=True)
    restored = written.repartitionAndSortWithinPartitions(written.getNumPartitions(), _key_hash).mapPartitions(_restore_job)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return spark.createDataFrame(restored, schema, verifySchema=False)


def _transform_text(doc_id: int | None, text: str | None, seed: int, rate: int, spm_rate: int) -> tuple[str, str]:
    data = (text or "").encode()
    parts = list(pieces_of(doc_id, data, seed, rate, spm_rate))
    return parts[0][1][1], b"".join(p for p, _ in parts).decode()


def restore_text(output: str, form: str) -> str:
    """The text that an output of this form was made of: the marks are the only ones in it, so each part lies between two of them."""
    if form == "plain":
        return output
    order = [m.decode() for m in _ORDER[form]]
    first, second = output.index(order[1]), output.index(order[2])
    parts = {order[0]: output[3:first], order[1]: output[first + 3 : second], order[2]: output[second + 3 :]}
    return parts["<P>"] + parts["<M>"] + parts["<S>"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form_col: str = "form", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with transformed texts and form_col (plain, psm or spm), row by row: the texts themselves, to write or train on.

    Cases as in fill_in_middle_digests(); a null text stays null. A column of docs named form_col is replaced, all others stay.
    """
    docs = docs.drop(form_col)

    @F.arrow_udf("struct<form string, output string>")
    def written(ids, texts):
        import pyarrow as pa

        found = [_transform_text(i.as_py(), t.as_py(), seed, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
        return pa.StructArray.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([o for _, o in found], pa.string())], names=["form", "output"])

    both = written(F.col(id_col).cast("long"), F.col(text_col))
    columns = [F.when(F.col(text_col).isNotNull(), both["output"]).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*columns, both["form"].alias(form_col))


def restore_documents(docs: DataFrame, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """docs of fill_in_middle() with their first texts again, by SQL functions; form_col goes."""
    text, form = F.col(text_col), F.col(form_col)
    cut = lambda lo, hi: F.substring_index(F.substring_index(text, lo, -1), hi, 1) if hi else F.substring_index(text, lo, -1)
    psm = F.concat(cut("<P>", "<S>"), cut("<M>", None), cut("<S>", "<M>"))
    spm = F.concat(cut("<P>", "<M>"), cut("<M>", None), cut("<S>", "<P>"))
    whole = F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
    return docs.select(*[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != form_col])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' outputs and restored texts."""
    return fill_in_middle_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
