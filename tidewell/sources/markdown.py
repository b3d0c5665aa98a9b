"""A sink that writes one Markdown file a row, all or none: a Python data source with commit and abort.

    spark.dataSource.register(MarkdownSource)
    pages.select("name", "text").write.format("markdown_files").mode("append").save(folder)

A task writes below a staging folder that the write begins with; the commit moves the files of the tasks that succeeded to their names, where they replace files of
these names, and an abort removes the folder. So a failed write leaves no file and a repeated task no second one. Of rows with one name the last task's file
stays. Tasks that still run when the write is aborted cannot bring the staging folder back. The folder may be any that pyarrow's file systems reach; executors have to share it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewell.functions import text as X

#: How often an abort or commit tries to remove the staging folder while tasks still add to it.
CLEARS = 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is staged, and its name


class MarkdownWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, context = [], TaskContext.get()
        store, folder = opened(f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}")
        store.create_dir(folder, recursive=False)  # fails if an abort has removed the staging folder
        for i, row in enumerate(iterator):
            with store.open_output_stream(f"{folder}/{i}") as out:
                out.write((row["text"] or "").encode())
            files.append((f"{folder}/{i}", row["name"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for message in messages:
            for staged, name in message.files if message else []:
                store.move(staged, f"{folder}/{name}.md")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = opened(self.staging)
        for left in range(CLEARS, 0, -1):
            try:
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)
                return
            except OSError:  # a task that still ran has added to it meanwhile
                if left == 1:
                    raise
                time.sleep(0.05)


class MarkdownSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> MarkdownWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: write in mode append")
        made = MarkdownWriter(self.options["path"])
        store, folder = opened(made.staging)
        store.create_dir(folder)
        return made


def write_pages(pages: DataFrame, to: str, full_width: bool = False) -> None:
    """Markdown documents (name, text) as NAME.md, forbidden characters of names replaced. Rows whose name is null or empty are left out."""
    pages.sparkSession.dataSource.register(MarkdownSource)
    named = pages.select(X.strip(X.file_name(F.col("name"), full_width)).alias("name"), F.col("text").cast("string").alias("text"))
    named.where("name != ''").write.format("markdown_files").mode("append").save(to)
