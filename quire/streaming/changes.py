"""An extension: a stream of the documents of a bundle that changed, by path, time and size.

Each trigger lists the tree and emits files whose signature the offset doesn't
know yet.  The offset is a digest-sized summary per file, so this is for trees whose
listing fits the driver, as discovery itself is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..sources.discovery import discover
from ..sources.exclusion import Exclusion


class ChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root = options["root"]
        self.exclude = [x for x in (options.get("exclude") or "").split("\n") if x]

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def _listing(self) -> dict[str, int]:
        root = Path(self.root).resolve()
        out = {}
        for p in discover(root, Exclusion.read(root, self.exclude)):
            s = (root / p).stat()
            out[p] = zlib.crc32(f"{s.st_mtime_ns}:{s.st_size}".encode())
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = json.loads(start["seen"]), self._listing()
        root = Path(self.root).resolve()
        rows = [(p, bytearray((root / p).read_bytes()), False) for p, s in now.items() if before.get(p) != s]
        rows += [(p, None, True) for p in before if p not in now]
        return iter(rows), {"seen": json.dumps(now)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same files again; their content is as it is now."""
        before, now = json.loads(start["seen"]), json.loads(end["seen"])
        root = Path(self.root).resolve()
        for p, s in now.items():
            if before.get(p) != s and (root / p).is_file():
                yield p, bytearray((root / p).read_bytes()), False
        for p in before:
            if p not in now:
                yield p, None, True

    def commit(self, end: dict) -> None:
        pass


class ChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle_changes"

    def schema(self) -> str:
        return "path string, content binary, removed boolean"

    def simpleStreamReader(self, schema: StructType) -> ChangesReader:
        return ChangesReader(self.options)


def read_changes(spark: SparkSession, root: str, exclude=()) -> DataFrame:
    """path, content, removed: a streaming DataFrame of changed documents; parse it with operators.parse."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format("bundle_changes").option("root", str(Path(root).resolve())).option("exclude", "\n".join(exclude)).load()


