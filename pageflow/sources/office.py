"""Zipped office files as a data source: only the directory of a file and the parts that are asked for are read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from pageflow.sources.io import OFFICE_PARTS, part_batches, part_of

EXTENSIONS = (".docx", ".odt", ".pptx")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Run(InputPartition):
    """Files of a task, or the parts of one file: (path, names), names None for all of it."""

    files: list[tuple[str, list[str] | None]]

    def __post_init__(self):
        super().__init__(None)


class OfficeReader(DataSourceReader):
    """Options: ``path`` (a folder, read with what is below it, or a file), ``bytes`` of a task, ``data`` (false: no contents), ``kind`` (parted by commas)."""

    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("bytes", 64 << 20))
        self.data = options.get("data", "true").lower() != "false"
        kinds = options.get("kind")
        self.kinds = set(kinds.split(",")) if kinds else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of ``kind`` decides which parts are read; Spark applies all other conditions."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) and f.attribute == ("kind",) else set(f.value) if isinstance(f, In) and f.attribute == ("kind",) else None
            if values is None:
                yield f
            else:
                self.kinds = values if self.kinds is None else self.kinds & values

    def _files(self) -> list[fs.FileInfo]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(EXTENSIONS)), key=lambda f: f.path)

    def _name(self, path: str) -> str:
        """With the scheme and host of the option's path; paths of stores with buckets begin with the bucket."""
        if "://" not in self.path:
            return path
        scheme, _, rest = self.path.partition("://")
        return f"{scheme}://{rest.split('/')[0] if path.startswith('/') else ''}{path}"

    def partitions(self) -> list[Run]:
        """Files together up to ``bytes``; a larger one by runs of its parts, for which alone its directory is read here."""
        runs, now, held = [], [], 0
        for f in self._files():
            name = self._name(f.path)
            pieces = [(f.size, None)] if f.size <= self.bytes else self._parts(name)
            for size, names in pieces:
                if now and held + size > self.bytes:
                    runs.append(Run(now))
                    now, held = [], 0
                now.append((name, names))
                held += size
        return [*runs, Run(now)] if now else runs or [Run([])]

    def _parts(self, name: str) -> list[tuple[int, list[str] | None]]:
        out, names, held = [], [], 0
        try:
            with self._open(name) as file, zipfile.ZipFile(file) as z:
                for x in z.infolist():
                    if (part := part_of(x.filename)) and self._wanted(x.filename, part[0]):
                        if names and held + x.compress_size > self.bytes:
                            out.append((held, names))
                            names, held = [], 0
                        names.append(x.filename)
                        held += x.compress_size
        except zipfile.BadZipFile:
            return [(0, None)]
        return [*out, (held, names)] if names else out

    def _open(self, name: str):
        system, path = located(name)
        file = system.open_input_file(path)
        return file if file.size() >= 22 else io.BytesIO(file.read())  # no zip is shorter, and zipfile would look before its start

    def _wanted(self, name: str, kind: str) -> bool:
        return self.kinds is None or kind in self.kinds

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        for path, names in partition.files:
            chosen = None if names is None else set(names)
            with self._open(path) as file:
                yield from part_batches(path, file, lambda n, k, chosen=chosen: self._wanted(n, k) and (chosen is None or n in chosen), self.data)


class OfficeSource(DataSource):
    """``spark.read.format("office_parts")``: (path, part_name, kind, ordinal, mime, data), as ``io.office_parts`` gives."""

    @classmethod
    def name(cls) -> str:
        return "office_parts"

    def schema(self) -> str:
        return OFFICE_PARTS

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, conditions on ``kind`` included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeSource)


def read_office_parts(spark: SparkSession, path: str, kinds: list[str] | None = None, data: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """Parts of the office files below ``path``, which workers reach through pyarrow's file systems: mounted disks, HDFS and object stores.

    Files are dealt to tasks by their sizes, a large one by runs of its parts; a task reads the files' directories and the
    parts of ``kinds`` alone. Conditions on ``kind`` that are put on the result later prune alike. Without ``data`` no contents are read.
    """
    register(spark)
    options = {"path": path, "data": str(data).lower(), "bytes": str(task_bytes)} | ({"kind": ",".join(kinds)} if kinds is not None else {})
    return spark.read.format("office_parts").options(**options).load()
