"""One JSON file for each document: a sink whose files appear when all of them are written, and the way back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """Names that a task wrote, under a name that is its own."""

    task: str
    names: list[str] = field(default_factory=list)


class DocumentFiles(DataSource):
    """Writes rows (name, raw) as <name>.json, two spaces to a level, with a newline at the end.

    Tasks write into a folder of their own beside the target; commit moves the files of the
    tasks that count into place, abort takes everything away.  Paths are those of any store
    that Arrow knows, shared by driver and executors.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = self._open()
        done = Written(f"task-{TaskContext.get().taskAttemptId()}")
        store.create_dir(f"{path}/_writing/{done.task}", recursive=True)
        for batch in iterator:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = json.dumps(json.loads(raw), indent=2, ensure_ascii=False) + "\n"
                with store.open_output_stream(f"{path}/_writing/{done.task}/{name}.json") as out:
                    out.write(text.encode())
                done.names.append(f"{name}.json")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._open()
        new = {n for m in messages if m for n in m.names}
        for m in messages:
            for n in m.names if m else ():
                store.move(f"{path}/_writing/{m.task}/{n}", f"{path}/{n}")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(path)):
                if info.is_file and info.extension == "json" and info.base_name not in new:
                    store.delete_file(info.path)
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    @staticmethod
    def _clear(store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_writing").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_writing")


def save(docs: DataFrame, path: str, name: str = "doc_id", overwrite: bool = False) -> None:
    """Write `docs` (name, raw) as a file each; names must be distinct and fit for files."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentFiles)
    rows = docs.select(F.col(name).cast("string").alias("name"), "raw")
    rows.write.format("document_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def saved(spark: SparkSession, path: str) -> DataFrame:
    """(name, raw) of the documents in a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1).alias("name"), F.col("value").alias("raw"))
