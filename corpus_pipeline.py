"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.classifier import THRESHOLD, score_quality, train
from captionlake.llm.jaccard import jaccard_join
from captionlake.llm.lines import drop_repeated_lines
from captionlake.llm.packing import pack, token_pieces
from captionlake.llm.secrets import redact_secrets
from captionlake.llm.tables import discard, materialize, spare_names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject.

    Cases: null and empty texts are scored alike, as empty ones; equal texts have equal scores, so repeated rows stay or go
    together; a score at the threshold stays; a very long text is scored whole; without labels in reach all scores are near 0.5 and
    all rows stay; an empty table gives no rows; all columns stay, whatever their names.
    """
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = spare_names(docs, "score")
    return score_quality(docs, machine, score_col=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that loses all its lines goes.

    Cases: null and empty texts stay as they are; a tie (rows of one id) counts as one place, so repeated rows lose the same lines and
    never each other's; rows without an id stay whole; very long texts are cut line by line; an empty table gives no rows; all
    columns stay, whatever their names; n_chars, where there is such a column, follows the text.
    """
    n_lines, n_removed = spare_names(docs, "n_lines", "n_removed")
    out = drop_repeated_lines(docs, n_lines_col=n_lines, n_removed_col=n_removed)
    return _same_columns(out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines))), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the least id) of each group of near copies.

    Cases: null and empty texts are no near copies of anything and stay; rows that repeat the least id of their group all stay (no other
    row tells them apart); rows without an id stay; very long texts are one set of shingles like others; an empty table gives
    no rows; all columns stay, whatever their names.
    """
    (later_id,) = spare_names(docs, "later_id")
    later = jaccard_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(later_id)).distinct()
    return docs.join(later, docs["doc_id"].cast("long") == later[later_id], "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked.

    Cases: null texts stay null and empty ones empty; overlapping spans are masked once; repeated rows and ids are masked one
    by one, alike; very long texts are scanned whole; without secrets nothing changes; an empty table gives no rows; all columns stay,
    whatever their names; n_chars, where there is such a column, follows the text.
    """
    return _same_columns(redact_secrets(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 ids.

    Cases: null and empty texts are a piece of one id; repeated rows and ids are packed one by one; texts of more ids are cut into pieces;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return pack(token_pieces(docs))


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL can express none of the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
