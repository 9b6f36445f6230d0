"""Bundles as a Spark data source: ``spark.read.format("bundle").option("root", …)``.

The driver walks the tree and deals the paths to partitions; workers read the
files.  Options: root, exclude (patterns, one a line), capability (``identity``
reads no content), partitions.  Filters on ``path`` (equal, in, begins with) are
applied while planning, so files that they leave out are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .discovery import discover
from .exclusion import Exclusion

SCHEMA = "ordinal long, path string, size long, content binary, read_error string"


class Piece(InputPartition):
    def __init__(self, paths: list[tuple[int, str]]):
        super().__init__(0)
        self.paths = paths


class BundleReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("root") or options.get("path")
        if not self.root:
            raise ValueError("option root is missing")
        self.exclude = [x for x in (options.get("exclude") or "").split("\n") if x]
        self.identity = (options.get("capability") or "content") == "identity"
        self.wanted = int(options.get("partitions") or 0)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            yield f  # Spark looks again; the filter is exact, but it costs nothing

    def _wants(self, path: str) -> bool:
        for f in self.filters:
            if isinstance(f, EqualTo) and path != f.value or isinstance(f, In) and path not in f.value or isinstance(f, StringStartsWith) and not path.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[Piece]:
        root = Path(self.root)
        found = [(i, p) for i, p in enumerate(discover(root, Exclusion.read(root, self.exclude))) if self._wants(p)]
        n = self.wanted or max(1, min(4096, len(found) // 1000 + 1))
        step = max(1, -(-len(found) // n))
        return [Piece(found[i : i + step]) for i in range(0, len(found), step)] or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ordinal", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("read_error", pa.string())])
        root = Path(self.root).resolve()
        for at in range(0, len(partition.paths), 256):
            rows = []
            for ordinal, path in partition.paths[at : at + 256]:
                row = {"ordinal": ordinal, "path": path, "size": None, "content": None, "read_error": None}
                try:
                    if self.identity:
                        row["size"] = (root / path).stat().st_size
                    else:
                        row["content"] = (root / path).read_bytes()
                        row["size"] = len(row["content"])
                except OSError as e:
                    row["read_error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options)


def read_bundle(spark: SparkSession, root: str, exclude=(), capability: str = "content", partitions: int | None = None) -> DataFrame:
    if isinstance(exclude, str):
        raise TypeError(f"exclude takes a sequence of patterns, not the single string {exclude!r}")
    if not Path(root).is_dir():
        raise NotADirectoryError(f"Markdown root is not a directory: {Path(root).resolve()}")
    spark.dataSource.register(BundleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader with pushFilters is refused
    reader = spark.read.format("bundle").option("root", str(Path(root).resolve())).option("exclude", "\n".join(exclude)).option("capability", capability)
    return (reader.option("partitions", str(partitions)) if partitions else reader).load()
