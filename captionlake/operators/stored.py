"""Conditional updates of stored tables: only the buckets of projects that change are read and written.

A stored table is a folder of Parquet files laid out by ``bucket``, a hash of the project: ``bucket=17/...``. An update reads the buckets of
the projects it is about (partition pruning), and writes these buckets anew by dynamic partition overwrite, which replaces
a bucket's files when the job commits; all other buckets' files stay as they are. A bucket left without rows is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators.lineage import cut
from captionlake.operators.records import migrate_words_v3, recover_jobs

BUCKETS = 64


def bucket_of(project: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(project.cast("string")), F.lit(buckets)).cast("int")


def store_table(rows: DataFrame, path: str, key: str = "project_id", buckets: int = BUCKETS) -> None:
    """Write rows as a stored table; the number of buckets is kept in the folder names, so choose it once."""
    rows.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table."""
    return spark.read.parquet(path).drop("bucket")


def _delete(spark: SparkSession, path: str, buckets: list[int]) -> None:
    for b in buckets:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], keys: DataFrame | None = None, where: Column | None = None, key: str = "project_id", buckets: int = BUCKETS) -> list[int]:
    """Replace the touched buckets' rows by ``change`` of them; returns the buckets written or emptied.

    Touched are the buckets of ``keys`` (a table with the key column), or those that have a row for which ``where`` holds; both: such a
    row of such a key's bucket. Bucket numbers, a few bytes each and as many as the layout has, are all that meets on the driver. The new
    rows are spilled to the shared folder before the old ones go, as a job may not overwrite what it still reads.
    """
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "bucket"]
    if keys is not None:
        near = [r[0] for r in keys.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(near)) if near else rows.limit(0)
    touched = sorted(r[0] for r in (rows.where(where) if where is not None else rows).select("bucket").distinct().collect())
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    new = change(old.select(*columns)).withColumn("bucket", bucket_of(F.col(key), buckets))
    held = cut(new)
    left = {r[0] for r in held.select("bucket").distinct().collect()}
    if left:
        held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _delete(spark, path, [b for b in touched if b not in left])
    return touched


def purge_stored(spark: SparkSession, paths: list[str], gone: DataFrame, key: str = "project_id", buckets: int = BUCKETS) -> dict[str, list[int]]:
    """Delete the rows of gone projects from each table; the buckets that were rewritten."""
    keys = gone.select(key).distinct()
    return {path: update_table(spark, path, lambda rows: rows.join(keys, key, "left_anti"), keys, key=key, buckets=buckets) for path in paths}


def recover_stored_jobs(spark: SparkSession, path: str, open_states: tuple[str, ...] = ("queued", "running"), buckets: int = BUCKETS) -> list[int]:
    """Unfinished jobs of a stored table become failed with a reason; buckets without such jobs aren't written."""
    def failed(rows: DataFrame) -> DataFrame:
        return recover_jobs(rows, open_states).select(*rows.columns, *([] if "error" in rows.columns else ["error"]))

    return update_table(spark, path, failed, where=F.col("status").isin(*open_states), buckets=buckets)


def migrate_stored_words(spark: SparkSession, path: str, buckets: int = BUCKETS) -> list[int]:
    """Words of projects older than schema 3 are migrated; buckets without such projects aren't written."""
    return update_table(spark, path, lambda rows: migrate_words_v3(rows).select(*rows.columns), where=F.col("schema_version") < 3, buckets=buckets)
