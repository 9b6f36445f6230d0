"""Relational writes as differences of DataFrames: what an UPDATE, after ALTERs, means for each row's fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INTERNAL

ID = INTERNAL + "concept_id"


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """side, and rows that only one side has (as sets)."""
    return before.subtract(after).withColumn("side", F.lit("removed")).unionByName(after.subtract(before).withColumn("side", F.lit("added")))


def tampered(before: DataFrame, after: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """Keys whose protected columns differ; two nulls don't."""
    b = before.select(key, *[F.col(c).alias(f"__b_{c}") for c in protected])
    differ = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in protected])
    return after.join(b, key).where(differ).select(key)


def manifest_diff(before: DataFrame, after: DataFrame, key: str = "path", signature: tuple[str, ...] = ("size", "mtime_ns")) -> DataFrame:
    """key, change: added, removed or changed files."""
    b = before.select(key, F.struct(*signature).alias("__b"))
    a = after.select(key, F.struct(*signature).alias("__a"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


class WriteError(ValueError):
    """A write that can't be carried out."""


@dataclass
class Write:
    """ALTER steps and one UPDATE over a table of rows, kept as a plan; nothing is run until its rows are asked for."""

    before: DataFrame
    protected: tuple[str, ...] = (ID,)
    declared: tuple[str, ...] = ()
    structured: tuple[str, ...] = ()
    frame: DataFrame | None = None
    names: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.frame = self.before.withColumn("__selected", F.lit(False))
        self.names = {c: c for c in self.before.columns}

    def _guard(self, name: str) -> None:
        if name in self.protected or name.lower().startswith(INTERNAL):
            raise WriteError(f"column {name} is protected")

    def add(self, name: str, default: str | None = None) -> Write:
        self._guard(name)
        if name in self.frame.columns:
            raise WriteError(f"column {name} exists")
        if name.lower() in map(str.lower, self.structured):
            raise WriteError(f"column {name} is structured on some document")
        if name in self.declared:
            raise WriteError(f"column {name} is declared")
        self.frame = self.frame.withColumn(name, F.lit(default).cast("string"))
        self.added.append(name)
        return self

    def drop(self, name: str) -> Write:
        self._guard(name)
        if name not in self.frame.columns:
            raise WriteError(f"column {name} does not exist")
        self.frame = self.frame.drop(name)
        origin = next((k for k, v in self.names.items() if v == name), None)
        if origin is not None:
            del self.names[origin]
            self.dropped.append(origin)
        if name in self.added:
            self.added.remove(name)
        return self

    def rename(self, old: str, new: str) -> Write:
        self._guard(old)
        self._guard(new)
        if old in self.declared or new in self.declared:
            raise WriteError("a declared column can't be renamed")
        if old not in self.frame.columns or new in self.frame.columns:
            raise WriteError(f"can't rename {old} to {new}")
        self.frame = self.frame.withColumnRenamed(old, new)
        self.names = {k: new if v == old else v for k, v in self.names.items()}
        self.added = [new if a == old else a for a in self.added]
        return self

    def update(self, where: Column, **values: Column) -> Write:
        hit = F.coalesce(where, F.lit(False))
        new = {}
        for name, value in values.items():
            if name not in self.frame.columns:
                raise WriteError(f"column {name} does not exist")
            new[name] = F.when(hit, value).otherwise(F.col(name))
        self.frame = self.frame.withColumns(new | {"__selected": hit})
        return self

    def rows(self) -> DataFrame:
        return self.frame.drop("__selected")

    def selected(self) -> DataFrame:
        return self.frame.where("__selected").select(ID)

    def row_diff(self, authored: DataFrame) -> DataFrame:
        """ID, field, op (set or delete), value: what has to be written into each document.

        authored: ID, field for every key that a document has, null or not.
        Dropped columns delete the key; a renamed one moves to its last name where its old key was authored; others are set where the value changed, and a selected null that stays null deletes an authored key."""
        before = {c: c for c in self.before.columns if c not in self.protected}
        joined = self.before.select(ID, *[F.col(c).alias(f"__b_{c}") for c in before]).join(self.frame, ID)
        has = authored.groupBy(ID).agg(F.collect_set("field").alias("__has"))
        joined = joined.join(has, ID, "left")
        there = lambda c: F.coalesce(F.array_contains("__has", c), F.lit(False))
        no = F.lit(None).cast("string")
        entry = lambda f, op, v: F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), v.cast("string").alias("value"))
        items: list[Column] = []
        for c in before:
            now = self.names.get(c)
            if now is None:
                if c not in self.frame.columns:  # a column of that name that was added again sets it
                    items.append(F.when(there(c), entry(c, "delete", no)))
                continue
            moved = now != c
            value, was = F.col(now), F.col(f"__b_{c}")
            changed = ~value.eqNullSafe(was)
            if moved:
                if c not in self.frame.columns:
                    items.append(F.when(there(c), entry(c, "delete", no)))
                items.append(F.when((there(c) | changed) & value.isNotNull(), entry(now, "set", value)))
            else:
                items.append(F.when(changed & value.isNotNull(), entry(c, "set", value)).when((changed | F.col("__selected")) & value.isNull() & there(c), entry(c, "delete", no)))
        for c in self.added:
            value = F.col(c)
            was = F.col(f"__b_{c}") if c in before else no
            items.append(F.when(value.isNotNull() & ~value.eqNullSafe(was), entry(c, "set", value)).when(value.isNull() & there(c), entry(c, "delete", no)))
        changes = joined.select(ID, F.explode(F.array_compact(F.array(*items))).alias("__e")) if items else joined.select(ID).where("false").select(ID, entry("", "", no).alias("__e"))
        return changes.select(ID, "__e.field", "__e.op", "__e.value")
