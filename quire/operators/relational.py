"""Keys across documents: unique, primary and foreign keys over any relation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import fold, in_path_order
from . import rules


@dataclass(frozen=True)
class Key:
    """A primary key or a unique key of a type (or table)."""

    type_name: str
    columns: tuple[str, ...]
    primary: bool = False

    @property
    def name(self) -> str:
        return "_".join([self.type_name, *self.columns, "pkey" if self.primary else "key"])


@dataclass(frozen=True)
class Reference:
    """Columns of a type that have to name a row of another."""

    type_name: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return "_".join([self.type_name, *self.columns, *self.target_columns, "fkey"])


@dataclass(frozen=True)
class Constraints:
    keys: tuple[Key, ...] = ()
    references: tuple[Reference, ...] = ()


def _filled(columns) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def duplicate_rows(df: DataFrame, key: list[str], order: list, first: str) -> DataFrame:
    """Rows whose key (no null in it) an earlier row has, with ``first_`` + the first row's ``first``. Only keys that repeat are windowed: others are left out by an aggregation that combines before it shuffles."""
    whole = df.where(_filled(key))
    often = whole.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    some = whole.join(often, key, "left_semi")
    w = Window.partitionBy(*key).orderBy(*order)
    return some.withColumn("__rn", F.row_number().over(w)).withColumn(f"first_{first}", F.first(first).over(w)).where("__rn > 1").drop("__rn")


def null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.where(~_filled(key))


def dangling(df: DataFrame, columns: list[str], target: DataFrame, target_columns: list[str]) -> DataFrame:
    """Rows whose reference (no null in it) names no row of the target; target keys with a null don't count."""
    names = [f"__k{i}" for i in range(len(columns))]
    keys = target.where(_filled(target_columns)).select(*[F.col(c).alias(n) for c, n in zip(target_columns, names)]).distinct()
    own = df.where(_filled(columns))
    return own.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(columns, names)]), "left_anti")


def fields(concepts: DataFrame, names: list[str]) -> DataFrame:
    """concept columns, and per wanted field (folded name): value (text or null), n (spellings found), names (those), s (is it structured), kind (as what)."""
    front = F.parse_json("frontmatter_json")
    keys = F.json_object_keys("frontmatter_json")
    out = concepts.select("concept_id", "path", "concept_type", front.alias("__front"), keys.alias("__keys"), "frontmatter_json")
    for i, name in enumerate(names):
        folded = fold(name)
        spelled = F.filter("__keys", lambda k: F.translate(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == folded)
        out = out.withColumn(f"__names{i}", F.array_join(F.transform(F.array_sort(spelled), quoted), ", "))
        out = out.withColumn(f"__n{i}", F.coalesce(F.size(spelled), F.lit(0))).withColumn(f"__key{i}", F.get(spelled, F.lit(0)))
        entry = F.from_json("frontmatter_json", "map<string,string>")
        raw = F.try_element_at(F.transform_values(F.from_json("frontmatter_json", "map<string,variant>"), lambda k, v: F.schema_of_variant(v)), F.col(f"__key{i}"))
        out = out.withColumn(f"__kind{i}", F.when(raw.startswith("ARRAY"), F.lit("list")).otherwise(F.lit("dict")))
        out = out.withColumn(f"__s{i}", F.coalesce(~raw.isin("STRING", "VOID"), F.lit(False))).withColumn(f"__v{i}", F.when(raw == "STRING", F.try_element_at(entry, F.col(f"__key{i}"))))
    return out.drop("__front", "__keys", "frontmatter_json")


def check_constraints(concepts: DataFrame, schema: Constraints) -> DataFrame:
    """Diagnostics of all constraints: bad values, primary keys with nulls, duplicates, references without a target."""
    parts: list[DataFrame] = []
    for key in schema.keys:
        parts += _key(concepts, key)
    for reference in schema.references:
        parts += _reference(concepts, reference)
    if not parts:
        return concepts.sparkSession.createDataFrame([], "code string, severity string, path string, message string")
    return rules.in_order(rules.union(parts))


def _of(concepts: DataFrame, name: str, columns) -> DataFrame:
    folded = F.translate("concept_type", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == fold(name)
    return fields(concepts.where(folded), list(columns))


def quoted(x: Column) -> Column:
    """A text as messages show it: in single quotation marks, or double ones if only single ones are in it; backslashes, marks and line breaks escaped."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(single)


def _tuple(columns) -> Column:
    """The texts of some columns, as messages show several."""
    return F.concat(F.lit("("), F.array_join(F.array(*[quoted(F.col(c)) for c in columns]), ", "), F.lit(",)" if len(columns) == 1 else ")"))


def _bad(df: DataFrame, columns, name: str) -> list[DataFrame]:
    out = []
    for i, c in enumerate(columns):
        many = F.concat(F.lit(f"relational constraint {name!r} cannot resolve column {c!r}: frontmatter keys collide under DuckDB identifier equality: "), F.col(f"__names{i}"))
        out.append(rules.rows(df.where(f"__n{i} > 1"), 20, many))
        out.append(rules.rows(df.where(f"__n{i} = 1 and __s{i}"), 20, F.concat(F.lit(f"relational constraint {name!r} requires scalar string column {c!r}; found "), F.col(f"__kind{i}"))))
    return out


def _key(concepts: DataFrame, key: Key) -> list[DataFrame]:
    df = _of(concepts, key.type_name, key.columns)
    values = [f"__v{i}" for i in range(len(key.columns))]
    bad = _bad(df, key.columns, key.name)
    sound = df.where(" and ".join(f"__n{i} <= 1 and not __s{i}" for i in range(len(values))))
    again = duplicate_rows(sound, values, [in_path_order(F.col("path"))], "path")
    bad.append(rules.rows(again, 21, F.concat(F.lit(f"constraint {key.name!r} on {key.type_name!r} duplicates key "), _tuple(values), F.lit("; first seen at "), "first_path")))
    if key.primary:
        bad.append(rules.rows(null_keys(sound, values), 21, f"primary key {key.name!r} on {key.type_name!r} requires {key.columns!r} to be present"))
    return bad


def _reference(concepts: DataFrame, reference: Reference) -> list[DataFrame]:
    df = _of(concepts, reference.type_name, reference.columns)
    target = _of(concepts, reference.target, reference.target_columns)
    own, other = [f"__v{i}" for i in range(len(reference.columns))], [f"__v{i}" for i in range(len(reference.target_columns))]
    clean = lambda d, names: d.where(" and ".join(f"__n{i} <= 1 and not __s{i}" for i in range(len(names))))
    lost = dangling(clean(df, own), own, clean(target, other), other)
    said = F.concat(F.lit(f"foreign key {reference.name!r} on {reference.type_name!r} has no matching {reference.target!r}{reference.target_columns!r} for "), _tuple(own))
    return [*_bad(target, reference.target_columns, reference.name), *_bad(df, reference.columns, reference.name), rules.rows(lost, 22, said)]
