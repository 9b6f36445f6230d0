"""Per-value casts with the results that declared types promise, as Catalyst expressions.

A value that can't be cast is null and never an error.  Spark's own ``try_cast``
differs from the promised results for some texts; each difference is met by a guard
or by going through decimals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Declared type names, their family, the type that carries them, and bounds of integers.
_INTEGERS = {
    "TINYINT": ("tinyint", -(2**7), 2**7 - 1),
    "SMALLINT": ("smallint", -(2**15), 2**15 - 1),
    "INTEGER": ("int", -(2**31), 2**31 - 1),
    "BIGINT": ("bigint", -(2**63), 2**63 - 1),
    "UTINYINT": ("smallint", 0, 2**8 - 1),
    "USMALLINT": ("int", 0, 2**16 - 1),
    "UINTEGER": ("bigint", 0, 2**32 - 1),
    "UBIGINT": ("decimal(20,0)", 0, 2**64 - 1),
    "HUGEINT": ("decimal(38,0)", -(10**38) + 1, 10**38 - 1),
    "UHUGEINT": ("decimal(38,0)", 0, 10**38 - 1),
}
_ALIASES = {
    "STRING": "VARCHAR", "TEXT": "VARCHAR", "CHAR": "VARCHAR", "BPCHAR": "VARCHAR", "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN", "INT": "INTEGER", "INT4": "INTEGER", "SIGNED": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT",
    "INT2": "SMALLINT", "SHORT": "SMALLINT", "INT1": "TINYINT", "FLOAT4": "FLOAT", "REAL": "FLOAT", "FLOAT8": "DOUBLE", "NUMERIC": "DECIMAL", "DATETIME": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
}
_SIMPLE = {"VARCHAR": ("string", "string"), "BOOLEAN": ("boolean", "boolean"), "FLOAT": ("float", "float"), "DOUBLE": ("float", "double"), "DATE": ("date", "date"), "UUID": ("uuid", "string"), "TIMESTAMPTZ": ("timestamptz", "timestamp")}
_SIMPLE |= {n: ("timestamp", "timestamp_ntz") for n in ("TIMESTAMP", "TIMESTAMP_S", "TIMESTAMP_MS", "TIMESTAMP_NS")}


@dataclass(frozen=True)
class LogicalType:
    """A declared type: its name as a catalog gives it, its family, the Spark type that carries it, and a list's element."""

    sql: str
    family: str
    spark: str
    precision: int | None = None
    scale: int | None = None
    element: LogicalType | None = None

    @property
    def kind(self) -> str | None:
        """What an inference of the family's values would be called."""
        return {"string": "string", "uuid": "string", "boolean": "boolean", "integer": "integer", "float": "number", "decimal": "number", "date": "date", "timestamp": "datetime", "timestamptz": "datetime"}.get(self.family)


def logical_type(name: str) -> LogicalType:
    """A type that isn't known keeps its name, is ``unsupported`` and carried as text."""
    plain = " ".join(name.strip().split())
    if plain.endswith("[]"):
        element = logical_type(plain[:-2])
        return LogicalType(f"{element.sql}[]", "list", f"array<{element.spark}>", element=element)
    upper = plain.upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC|DEC)(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", upper):
        p, s = int(m[1] or 18), int(m[2] or (0 if m[1] else 3))
        return LogicalType(f"DECIMAL({p},{s})", "decimal", f"decimal({p},{s})", p, s)
    upper = re.sub(r"^(?:VARCHAR|CHAR|BPCHAR|TEXT|STRING) ?\( ?\d+ ?\)$", "VARCHAR", upper)
    upper = _ALIASES.get(upper, upper)
    if upper in _INTEGERS:
        return LogicalType(upper, "integer", _INTEGERS[upper][0])
    if upper in _SIMPLE:
        return LogicalType("TIMESTAMP WITH TIME ZONE" if upper == "TIMESTAMPTZ" else upper, *_SIMPLE[upper])
    return LogicalType(plain, "unsupported", "string")


_NUMBER = r"^\s*[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _integer(x: Column, name: str) -> Column:
    carrier, low, high = _INTEGERS[name]
    plain = F.regexp_replace(x, r"(?<=\d)_(?=\d)", "")
    wide = F.when(plain.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(plain).try_cast("decimal(38,0)")).otherwise(F.round(F.when(plain.rlike(_NUMBER), F.trim(plain)).try_cast("decimal(38,10)"), 0).try_cast("decimal(38,0)"))
    fits = wide.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    return F.when(fits, wide).try_cast(carrier)


def typed(x: Column, kind: LogicalType) -> Column:
    """``x`` (text, or an array of it for a list) as the declared type, or null."""
    if kind.family == "list":
        return F.transform(x, lambda e: typed(e, kind.element))
    if kind.family == "integer":
        return _integer(x, kind.sql)
    if kind.family == "boolean":
        return F.when(F.lower(x).isin("true", "t", "yes", "y", "1"), F.lit(True)).when(F.lower(x).isin("false", "f", "no", "n", "0"), F.lit(False))
    if kind.family == "float":
        return F.when(~x.rlike(r"[dDfF]\s*$") | x.rlike(r"(?i)^\s*[+-]?(inf)\s*$"), F.trim(x)).try_cast(kind.spark)
    if kind.family == "date":
        return F.when(x.rlike(r"^\s*[+-]?\d+-\d{1,2}-\d{1,2}"), F.trim(x)).try_cast("date")
    if kind.family in ("timestamp", "timestamptz"):
        return F.when(x.rlike(r"^\s*[+-]?\d+-\d{1,2}-\d{1,2}"), F.trim(x)).try_cast(kind.spark)
    if kind.family == "uuid":
        bare = F.regexp_replace(F.lower(F.trim(x)), r"^\{|\}$|-", "")
        shaped = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")
        return F.when(bare.rlike("^[0-9a-f]{32}$"), shaped)
    return x.try_cast(kind.spark)
