"""Line dedup: repeated runs of lines, found by a suffix array over line ids built by distributed prefix doubling.

The non-blank lines of all documents, in order of document id, are one sequence with a gap after each document; a line's place is
its number in it. In round k every place whose next 2^k lines occur more than once holds the name of that block: the first
place where it occurs. Two neighbouring names make the name of a block twice as long, so the names are the ranks of prefix doubling.
Places whose block is unique have no longer repeats and leave, so each round handles the repeated part only.

The places that share a block of n lines are a longest-common-prefix interval of depth n of the suffix array, and all but
the first of them are later copies. The interval of any depth is named by the names of the block's first and last 2^k lines
(2^k <= n < 2^(k+1)). A maximal repeated run of MIN_WORDS words or more is the union of its shortest blocks with so many words: those
that start at one of its lines and those that end at one. They have at most MIN_WORDS lines, so intervals of greater depth
need not be formed. Later copies of these blocks are joined into runs in each document, and all lines of the runs go, but
for those inside the first copy itself: where a line repeats itself, the copies of a block overlap, and the first one stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from captionlake.llm.tables import discard, materialize, spare_names

MIN_WORDS = 20
_WORD = r"[^\x20\x09-\x0D]+"


def _shortest(min_words: int):
    """For each line of a text, from the lines' word counts: the lines of the shortest blocks of min_words words that start and that end there (0: none)."""

    @F.arrow_udf("array<struct<ahead int, behind int>>")
    def blocks(words: pa.Array) -> pa.Array:
        flat = words.flatten().to_numpy(zero_copy_only=False)
        many = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        edge = np.append(0, np.cumsum(many)).astype(np.int64)
        upto = np.append(0, np.cumsum(flat)).astype(np.int64)
        begin, finish = np.repeat(edge[:-1], many), np.repeat(edge[1:], many)
        at = np.arange(len(flat), dtype=np.int64)
        end = np.searchsorted(upto, upto[:-1] + min_words, "left")
        start = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
        ahead = np.where(end <= finish, end - at, 0).astype(np.int32)
        behind = np.where(start >= begin, at + 1 - start, 0).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(ahead), pa.array(behind)], names=["ahead", "behind"])
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), rows)

    return blocks


def text_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, k1, k2, ahead, behind): every non-blank line, named by 128 bits of hash, with the lines of its shortest blocks."""
    lists = docs.select("doc_id", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD)).alias("lines"))
    counts = F.transform("lines", lambda x: F.regexp_count(x, F.lit(_WORD)))
    rows = lists.select("doc_id", "lines", _shortest(min_words)(counts).alias("blocks"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("lines", "blocks")).alias("line", "z"))
    return rows.select("doc_id", "line", F.xxhash64("z.lines").alias("k1"), F.xxhash64(F.lit(17), "z.lines").alias("k2"), "z.blocks.ahead", "z.blocks.behind")


def _placed(rows: DataFrame) -> DataFrame:
    """Add the place of each line: its number, plus the lines (and a gap of one) of all documents with smaller ids.

    Documents are summed up inside ranges of ids, one task each; only the ranges' totals, one row each, meet in one window.
    """
    spans = rows.groupBy("doc_id").agg((F.max("line") + 2).cast("long").alias("span"))
    spans = materialize(spans.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = spans.groupBy("part").agg(F.sum("span").alias("span")).select("part", upto(Window.orderBy("part")).alias("before"))
    starts = spans.withColumn("inside", upto(Window.partitionBy("part").orderBy("doc_id"))).join(before, "part")
    starts = starts.select("doc_id", (F.col("before") + F.col("inside")).alias("start"))
    out = materialize(rows.join(starts, "doc_id").withColumn("place", F.col("start") + F.col("line")).drop("start"))
    discard(spans)
    return out


def _named(rows: DataFrame) -> DataFrame:
    """The rows whose (k1, k2) occurs more than once, with a name for it: the first place that has it.

    Counting is merged map-side and the names are joined back, so a line in a third of all documents is never one group.
    """
    names = materialize(rows.groupBy("k1", "k2").agg(F.min("place").alias("name"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "name"))
    out = materialize(rows.join(names, ["k1", "k2"]).drop("k1", "k2"))
    discard(names)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, lines): blocks of lines with enough words that an earlier place also has, without lines of that first copy."""
    rows = text_lines(docs, min_words)
    twice = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    again = materialize(rows.join(twice, ["k1", "k2"]))
    placed = _placed(again)
    discard(again)
    base = _named(placed)
    discard(placed)
    ahead = base.where("ahead > 0").select("place", F.col("ahead").alias("lines"), "doc_id", "line")
    behind = base.where("behind > 0").select((F.col("place") - F.col("behind") + 1).alias("place"), F.col("behind").alias("lines"), "doc_id", (F.col("line") - F.col("behind") + 1).alias("line"))
    blocks = materialize(ahead.unionByName(behind).distinct())
    now, step, found = base.select("place", "name"), 1, None
    held = [base]
    while True:
        first = now.select("place", F.col("name").alias("first"))
        last = now.select(F.col("place").alias("at"), F.col("name").alias("last"))
        part = blocks.where((F.col("lines") >= step) & (F.col("lines") < 2 * step)).join(first, "place")
        part = part.withColumn("at", F.col("place") + F.col("lines") - step).join(last, "at")
        # the depth goes into the second key: intervals of other depths may share both names
        part = part.select("place", "doc_id", "line", "lines", F.col("first").alias("k1"), F.struct("last", "lines").alias("k2"))
        # a copy that overlaps the first one loses what lies behind it only
        over = F.greatest(F.lit(0), F.col("name") + F.col("lines") - F.col("place")).cast("int")
        part = _named(part).where("name < place").select("doc_id", (F.col("line") + over).alias("line"), (F.col("lines") - over).alias("lines"))
        found = part if found is None else found.unionByName(part)
        if 2 * step > min_words or now.isEmpty():
            discard(blocks, *held)
            return found
        after = now.select((F.col("place") - step).alias("place"), F.col("name").alias("k2"))
        now = _named(now.select("place", F.col("name").alias("k1")).join(after, "place"))
        discard(*held)
        held, step = [now], 2 * step


def _cut(text_col: str, cut_col: str, n_lines_col: str, n_removed_col: str):
    word = re.compile(_WORD)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, n_lines, n_removed = [], [], []
                for text, cuts in zip(part.column(text_col), part.column(cut_col), strict=True):
                    text, cuts = text.as_py(), cuts.as_py()
                    lines = (text or "").split("\n")
                    solid = [i for i, s in enumerate(lines) if word.search(s)]
                    gone: list[int] = []
                    if cuts:
                        edge = np.zeros(len(solid) + 1, np.int64)
                        pairs = np.array([(c["line"], c["line"] + c["lines"]) for c in cuts])
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                        gone = np.array(solid)[np.cumsum(edge[:-1]) > 0].tolist()
                        drop = set(gone)
                        text = "\n".join([s for i, s in enumerate(lines) if i not in drop])
                    texts.append(text)
                    n_lines.append(len(solid))
                    n_removed.append(len(gone))
                names = [n for n in part.schema.names if n != cut_col]
                columns = [pa.array(texts, pa.string()) if n == text_col else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, n_lines_col, n_removed_col]
                )

    return job


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", n_lines_col: str = "_n_lines", n_removed_col: str = "_n_removed"
) -> DataFrame:
    """docs with later copies of repeated line runs cut from the text, and the numbers of non-blank lines and of those removed.

    Earlier means a smaller id, then a smaller line number. Cases: blank lines stay and neither make nor break a run; null and empty
    texts stay as they are; any 64-bit id will do; rows without an id stay whole and are nobody's source; rows that share an id must be
    equal copies, which lose the same lines (of different texts under one id a line may be lost by both); a very long text is cut
    in one task, line by line; an empty table gives no rows; other columns stay, whatever their names, and columns of docs that are
    named like the two counts are replaced by them.
    """
    docs = docs.drop(n_lines_col, n_removed_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    key, cut = spare_names(docs, "cut_id", "cuts")
    cuts = later_copies(slim, min_words).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("line", "lines")).alias(cut))
    joined = docs.join(cuts, docs[id_col].cast("long") == cuts[key], "left").drop(key)
    schema = StructType(list(docs.schema.fields)).add(n_lines_col, LongType()).add(n_removed_col, LongType())
    return joined.mapInArrow(_cut(text_col, cut, n_lines_col, n_removed_col), schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents after line dedup."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
