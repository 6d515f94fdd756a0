"""Proportional stratified interleaving: shards of equal row counts that each match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 20_000


def _ranked(df: DataFrame, cell: list[str], order: list, name: str, by: list[str]) -> DataFrame:
    """Number the rows of each ``by`` group from 0 in the order (cell, order), no group being one task's work.

    cell splits a group into ordered parts of bounded size; rows are numbered inside a part and the counts of
    the parts before it are added.
    """
    inside = Window.partitionBy(*by, *cell).orderBy(*order)
    before = Window.partitionBy(*by).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, *cell).agg(F.count("*").alias("_n"))
    starts = counts.select(*by, *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [*by, *cell]
    ranked = df.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, keys).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def stratified_shards(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Deal every row into ``shards`` shards by the law ``rows``: counts differ by one at most.

    Rows are shuffled by a seeded hash within their source and given the fractional rank
    (rank + 1/2) / (rows of the source); all rows in the order of that fraction are cut into equal runs, so each
    run holds every source in proportion. Ranks are counts over cells of a hash or of the fraction, both even
    by construction, so a source or a group of copies with a third of all rows spreads over many tasks.

    Cases: a null source is a stratum of its own; a null text has size 1 and the checksum of no bytes; a very long text is one row
    like others; repeated rows and ids are dealt one by one (ties are put in order by id, checksum, size); an empty table gives no
    rows; other columns are ignored, whatever their names.

    Returns id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    per_source = rows.groupBy("_source").agg(F.count("*").alias("_rows"))
    # 60 bits of a digest that other engines have too
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string"), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("_u", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    ties = ["_id", "text_crc32", "size"]
    total = docs.count()
    cells = max(shards, -(-total // ROWS_PER_CELL))
    rows = rows.withColumn("_cell", F.shiftrightunsigned(F.col("_u"), 33) % cells)
    rows = _ranked(rows, ["_cell"], ["_u", *ties], "_rank", ["_source"])
    # a source has at least one row here, and at most as many sources as rows: the counts are joined, not collected
    rows = rows.join(per_source, "_source")
    rows = rows.withColumn("_part", (F.col("_rank") + 0.5) / F.col("_rows"))
    rows = rows.withColumn("_all", F.lit(0)).withColumn("_cell", F.floor(F.col("_part") * cells))
    rows = _ranked(rows, ["_cell"], ["_part", "_source", "_u", *ties], "_place", ["_all"])
    # shard s takes the places from ceil(s * total / shards) on
    shard = F.expr(f"(_place * {shards}) div {max(total, 1)}")
    rows = rows.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return rows.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("_source").alias("stratum"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15."""
    return stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
