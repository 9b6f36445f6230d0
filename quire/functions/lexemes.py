"""What kind of value a text spells, as Catalyst predicates, and votes over columns of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of lexemes, whole texts (\z, as $ would let a last line break through).
INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9]"
DATETIME = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt]{CLOCK}(:[0-5][0-9](\.[0-9]+)?)?([Zz]|[+-]{CLOCK})?\z"
#: In order: the first kind that all values have is the column's.
KINDS = ("boolean", "integer", "number", "date", "datetime")


def real_date(x: Column) -> Column:
    """Is the text's beginning a day that exists, in a year from 1 on?"""
    day = F.substring(x, 1, 10)
    return F.coalesce(day.rlike(DATE) & (F.substring(day, 1, 4) > "0000") & day.try_cast("date").isNotNull(), F.lit(False))


def is_kind(x: Column, kind: str) -> Column:
    return {
        "boolean": lambda: F.lower(x).isin("true", "false"),
        "integer": lambda: x.rlike(INTEGER),
        "number": lambda: x.rlike(NUMBER),
        "date": lambda: x.rlike(DATE) & real_date(x),
        "datetime": lambda: x.rlike(DATETIME) & real_date(x),
        "string": lambda: x.isNotNull(),
    }[kind]()


def can_cast(x: Column, kind: str) -> Column:
    """An explicit cast also takes what widens: integers as numbers, dates as datetimes."""
    if kind == "number":
        return is_kind(x, "number") | is_kind(x, "integer")
    if kind == "datetime":
        return is_kind(x, "datetime") | is_kind(x, "date")
    return is_kind(x, kind)


def kind_of_all(x: Column) -> Column:
    """An aggregate: the kind that all non-null values have, or string; of none, string."""
    out = F.lit("string")
    for kind in reversed(KINDS):
        out = F.when(F.coalesce(F.bool_and(is_kind(x, kind)), F.lit(False)), F.lit(kind)).otherwise(out)
    return out


def votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, kind: one aggregation over all columns at once, then a row each."""
    one = df.agg(*[kind_of_all(F.col(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("kind")) for c in columns])).alias("v")).select("v.field", "v.kind")
