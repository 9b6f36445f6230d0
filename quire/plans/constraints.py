"""Keys and references across types, read from CREATE TABLE statements."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.relational import Constraints, Key, Reference
from .sqltext import SqlError, tables


def constraints(script: str) -> Constraints:
    found = tables(script)
    by_name = {t.name.lower(): t for t in found}
    keys = [Key(t.name, tuple(c), True) for t in found for c in t.primary] + [Key(t.name, tuple(c)) for t in found for c in t.unique]
    references = []
    for t in found:
        for f in t.foreign:
            target = by_name.get(f.target.lower())
            if target is None:
                raise SqlError(f"{t.name} references the unknown table {f.target}")
            columns = f.target_columns or (tuple(target.primary[0]) if target.primary else ())
            if len(columns) != len(f.columns):
                raise SqlError(f"{t.name} references {f.target} with another number of columns")
            references.append(Reference(t.name, tuple(f.columns), target.name, columns))
    return Constraints(tuple(keys), tuple(references))


def load_constraints(spark: SparkSession, path: str) -> Constraints:
    return constraints(Path(path).read_text(encoding="utf-8"))
