"""Archives of packaged books, as tables of entries.

`entries()` reads whole archives through Spark's own file reader, so it reaches every store that Spark reaches.
ZipArchives is the same as a data source (format 'ziparchive') for paths that the executors can open, a
partition for each archive, and reads only entries whose paths pass its `suffix` option.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, path string, content binary"


def _entries(archive: zipfile.ZipFile, suffixes: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    for info in archive.infolist():
        path = info.filename.replace("\\", "/").lstrip("/")
        if not info.is_dir() and (not suffixes or path.lower().endswith(suffixes)):
            yield path, archive.read(info)


def entries(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, path, content) of every file in the archives at path (a file, folder or glob); suffixes keep only such paths."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for p, data in _entries(z, suffixes):
                        yield pa.RecordBatch.from_pydict({"archive": [name], "path": [p], "content": [data]}, pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(of, SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffixes = options["path"], tuple(x for x in options.get("suffix", "").lower().split(",") if x)

    def partitions(self) -> list[InputPartition]:
        at = Path(self.path)
        files = sorted(x for x in at.rglob("*") if x.suffix in (".epub", ".zip")) if at.is_dir() else [at]
        return [InputPartition(str(f)) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.value) as z:
            for p, data in _entries(z, self.suffixes):
                yield partition.value, p, data


class ZipArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def audio_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(ord, href, title) of the audio files at path, by name; durations come from a probe's table."""
    from pyspark.sql import Window

    from lectern.functions.paths import is_audio

    found = spark.read.format("binaryFile").load(path).select("path").where(is_audio(F.col("path")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ord_ = F.row_number().over(Window.orderBy(name)) - 1  # a folder's audio files
    return found.select(ord_.alias("ord"), name.alias("href"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"))
