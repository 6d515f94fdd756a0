"""A data source that writes one named file for each project, all of them or none.

    exports.register(spark)
    exports.named_documents(documents, "srt", "srt").write.format("caption_files").mode("append").save("/shared/exports")

Rows are (file, document). Each task writes its documents to a folder of its own below ``_staging`` and reports their names; only
when all tasks are done does the driver move the files to their places, one rename each. A failed task or job puts nothing in its place: its
staging folder is deleted (a task that still runs then may leave one, which readers skip as its name begins with ``_``). The target is any file system that Arrow knows (local or mounted folders, HDFS, object stores by URI).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "caption_files"
#: Renames at a time.
MOVERS = 16
#: Longest stem of a file name, in characters (file systems allow 255 bytes, a character has up to 4).
STEM = 60


@dataclass
class Staged(WriterCommitMessage):
    """The names that one task has written, and where."""

    folder: str
    names: list[str]


class NamedFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _folder(self):
        """The file system of the target and the target's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = self._folder()
        task = TaskContext.get()
        folder = f"{root}/_staging/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        names: list[str] = []
        for row in iterator:
            if not row["file"] or "/" in row["file"] or row["file"].startswith((".", "_")):
                raise ValueError(f"not a file name: {row['file']!r}")
            if not names:
                files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{row['file']}") as out:
                out.write((row["document"] or "").encode())
            names.append(row["file"])
        return Staged(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = self._folder()
        moves = [(f"{m.folder}/{name}", name) for m in messages if m for name in m.names]
        names = [name for _, name in moves]
        try:
            if len({*names}) < len(names):
                twice = sorted({n for n in names if names.count(n) > 1}) if len(names) < 10_000 else []
                raise ValueError(f"two documents have one file name: {twice[:3]}")
            files.create_dir(root, recursive=True)
            there = {f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
            if not self.overwrite and (same := there & {*names}):
                raise FileExistsError(f"{len(same)} files are there already, such as {min(same)}")
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda m: files.move(m[0], f"{root}/{m[1]}"), moves))
                if self.overwrite:  # what is left of the former export
                    list(pool.map(lambda name: files.delete_file(f"{root}/{name}"), there - {*names}))
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = self._folder()
        if files.get_file_info(f"{root}/_staging/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_staging/{self.job}")
        if files.get_file_info(f"{root}/_staging").type != fs.FileType.NotFound and not files.get_file_info(fs.FileSelector(f"{root}/_staging")):
            files.delete_dir(f"{root}/_staging")


class NamedFiles(DataSource):
    """Write-only: the files are read by the library's readers (read_subtitles and others)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"file", "document"} - {*schema.fieldNames()}
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return NamedFileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(NamedFiles)


def file_stem(name: Column) -> Column:
    """A project's name without its last extension and folders, of characters that all file systems take; ``project`` where nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    stem = F.trim(F.substring(F.regexp_replace(stem, r'[\x00-\x1f<>:"|?*]+', " "), 1, STEM))
    stem = F.regexp_replace(stem, r"^[._]+", "")
    return F.when(stem == "", "project").otherwise(stem)


def named_documents(documents: DataFrame, column: str, extension: str, projects: DataFrame | None = None, mark: bool = True) -> DataFrame:
    """(file, document): one row for each project (project_id and the column of text), named by the project.

    projects: (project_id, name); without it, or where a name is null, the id is the name. Names that several projects have get ``-2``, ``-3``
    and so on, in order of the ids, upper and lower case being the same. mark: begin documents with a byte order mark.
    """
    rows = documents.select("project_id", F.col(column).alias("document"))
    name = F.lit(None).cast("string")
    if projects is not None:
        rows, name = rows.join(projects.select("project_id", F.col("name").alias("_name")), "project_id", "left"), F.col("_name")
    rows = rows.withColumn("stem", F.when(name.isNotNull(), file_stem(name)).otherwise(F.col("project_id").cast("string")))
    place = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("project_id"))
    rows = rows.withColumn("place", place).withColumn("full", F.when(F.col("place") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", "place")))
    # a numbered name may be another project's own: then the id goes along
    taken = F.count("*").over(Window.partitionBy(F.lower("full"))) > 1
    full = F.when(taken & (F.col("place") > 1), F.concat_ws("-", "full", F.col("project_id").cast("string"))).otherwise(F.col("full"))
    text = F.coalesce("document", F.lit(""))
    return rows.select(F.concat(full, F.lit(f".{extension}")).alias("file"), (F.concat(F.lit("﻿"), text) if mark else text).alias("document"))


def write_documents(documents: DataFrame, column: str, extension: str, path: str, projects: DataFrame | None = None, overwrite: bool = False, mark: bool = True) -> None:
    """One file ``<name>.<extension>`` for each project in the folder; with overwrite it holds nothing else afterwards."""
    register(documents.sparkSession)
    rows = named_documents(documents, column, extension, projects, mark)
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)
