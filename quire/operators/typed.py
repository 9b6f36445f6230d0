"""Typed relations: one lazy projection per declared type, every value cast by itself."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import LogicalType, logical_type, typed
from ..functions.paths import fold, fold_column
from ..model import INTERNAL
from ..plans.contract import facts, observations, structured_fields
from ..plans.declared import Declaration, ddl

IDENTITY = ("path", "concept_id", "logical_key")
#: What ends a line of a body: CRLF, and each of these alone.
LINE = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


class TypedError(ValueError):
    """A type that can't be a table."""


def body_lines(body: Column) -> Column:
    """Lines without their ends; no empty one after the last end."""
    parts = F.split(body, LINE)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _entry(name: Column, kind: LogicalType | None) -> Column:
    """A field as written: a text, or for a list an array of texts and nulls; anything else is null."""
    raw = F.try_element_at(F.from_json("frontmatter_json", "map<string,string>"), name)
    variant = F.try_element_at(F.from_json("frontmatter_json", "map<string,variant>"), name)
    kind_of = F.schema_of_variant(variant)
    if kind is not None and kind.family == "list":
        return F.when(kind_of.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(raw, "array<string>"))
    return F.when(kind_of == "STRING", raw)


def _spelled(keys: Column, name: str) -> Column:
    """The keys that are ``name`` under folding."""
    folded = fold(name)
    return F.filter(keys, lambda k: fold_column(k) == folded)


def typed_table(concepts: DataFrame, concept_type: str, declaration: Declaration, undeclared: list[str]) -> DataFrame:
    """Internal columns, for each declared column what was written and its typed value, then undeclared scalar fields as texts."""
    own = concepts.where(F.col("concept_type") == concept_type)
    keys = F.json_object_keys("frontmatter_json")
    columns: list[Column] = [F.col(c).alias(INTERNAL + c) for c in IDENTITY]
    columns += [F.col("body").alias(INTERNAL + "body"), body_lines(F.col("body")).alias(INTERNAL + "body_lines")]
    for name, kind in declaration.columns.items():
        raw = _entry(F.get(_spelled(keys, name), F.lit(0)), kind)
        comment = {"comment": declaration.comments[name]} if name in declaration.comments else None
        columns += [raw.alias(f"{INTERNAL}raw_{name}"), typed(raw, kind).alias(name, metadata=comment) if comment else typed(raw, kind).alias(name)]
    columns += [_entry(F.lit(name), None).alias(name) for name in undeclared]
    return own.select(*columns)


def plan(concepts: DataFrame, declarations: Mapping[str, Declaration]) -> dict[str, list[str]]:
    """Undeclared scalar fields of each declared type, by folded name. One aggregation over all types; a field that is structured on any document is left out, and two spellings of one field are an error."""
    own = concepts.where(F.col("concept_type").isin(*declarations)) if declarations else concepts.where("false")
    names = [(r["concept_type"], r["field"]) for r in observations(own).where(F.size("path") == 1).select("concept_type", F.col("path")[0].alias("field")).distinct().collect()]  # a row per type and field
    structured = {(r["concept_type"], r["field"]) for r in structured_fields(own).collect()}
    keys = F.json_object_keys("frontmatter_json")
    for t, d in declarations.items():
        doubled = [F.max(F.when(F.col("concept_type") == t, F.size(_spelled(keys, c)))).alias(f"c{i}") for i, c in enumerate(d.columns)]
        most = own.agg(*doubled).first() if doubled else ()
        for c, n in zip(d.columns, most):
            if (n or 0) > 1:
                raise TypedError(f"a document of type {t!r} spells the declared column {c!r} in several ways")
    out: dict[str, dict[str, str]] = {t: {} for t in declarations}
    for kind, name in names:
        key = fold(name)
        if key in set(map(fold, declarations[kind].columns)) or (kind, key) in structured or key.startswith(INTERNAL):
            continue
        if out[kind].setdefault(key, name) != name:
            raise TypedError(f"type {kind!r} has undeclared fields that are one under folding: {out[kind][key]!r}, {name!r}")
    return {t: [name for _, name in sorted(found.items())] for t, found in out.items()}


class TypedRelations:
    """Typed tables by type. ``close`` drops the views that ``register`` made."""

    def __init__(self, concepts: DataFrame, declarations: Mapping[str, Declaration]):
        undeclared = plan(concepts, declarations)
        self._tables = {t: typed_table(concepts, t, d, undeclared[t]) for t, d in declarations.items()}
        self._views: list[str] = []
        self._spark = concepts.sparkSession
        self._closed = False

    def relation(self, concept_type: str) -> DataFrame:
        if self._closed:
            raise RuntimeError("typed relations are closed")
        return self._tables[concept_type]

    __getitem__ = relation

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def register(self) -> None:
        for name in self._tables:
            self.relation(name).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
            self._views.append(name)

    def close(self) -> None:
        for name in self._views:
            self._spark.catalog.dropTempView(name)
        self._views, self._closed = [], True

    def __enter__(self) -> TypedRelations:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: What a vote over a column may give, in order.
CANDIDATES = (("BOOLEAN", "boolean"), ("BIGINT", "integer"), ("DOUBLE", "number"), ("DATE", "date"), ("TIMESTAMPTZ", "datetime"))


#: Candidates that count only where the value's text is what the text was.
EXACT = ("BIGINT", "DATE")


def takes(x: Column, sql: str) -> Column:
    """Does a candidate type take a text? Narrowing ones only what they give back unchanged."""
    value = typed(x, logical_type(sql))
    return value.isNotNull() & (value.cast("string") == x) if sql in EXACT else value.isNotNull()


def starter(concepts: DataFrame) -> dict[str, str]:
    """A starter declaration for each type: the first candidate that takes all values, else text; fields without a value are left out."""
    kinds = F.transform_values(F.from_json("frontmatter_json", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    entries = concepts.where("concept_type <> ''").select("concept_type", F.explode(F.map_entries(F.from_json("frontmatter_json", "map<string,string>"))).alias("e"), kinds.alias("kinds"))
    values = entries.select("concept_type", F.col("e.key").alias("name"), F.col("e.value").alias("x"), F.try_element_at("kinds", F.col("e.key")).alias("kind")).where("name <> 'type'")
    counts = [F.count(F.when(F.col("kind") == "STRING", F.lit(1))).alias("n"), F.count(F.when(~F.col("kind").isin("STRING", "VOID"), F.lit(1))).alias("other")]
    counts += [F.count(F.when((F.col("kind") == "STRING") & takes(F.col("x"), sql), F.lit(1))).alias(sql) for sql, _ in CANDIDATES]
    out: dict[str, dict[str, str]] = {}
    for r in values.groupBy("concept_type", "name").agg(*counts).where("n > 0 and other = 0").orderBy("concept_type", "name").collect():
        out.setdefault(r["concept_type"], {})[r["name"]] = next((sql for sql, _ in CANDIDATES if r[sql] == r["n"]), "VARCHAR")
    return {t: ddl(t, columns) for t, columns in out.items()}


def cast_vote(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, candidate, filled, clean: how many values each candidate type takes (BIGINT and DATE only what they give back unchanged), in one pass over all columns."""
    made = []
    for c in columns:
        for sql, _ in CANDIDATES:
            made.append(F.struct(F.lit(c).alias("field"), F.lit(sql).alias("candidate"), F.count(c).alias("filled"), F.count(F.when(takes(F.col(c), sql), F.lit(1))).alias("clean")))
    return df.agg(F.array(*made).alias("v")).select(F.explode("v").alias("v")).select("v.*")


def export(spark: SparkSession, relations: Mapping[str, DataFrame], database: str, overwrite: bool = False, comments: Mapping[str, str] | None = None) -> dict[str, int]:
    """Tables of a database, all or none: written beside the old ones first, then swapped in; an old table is dropped only when the new one has its name. Returns their rows.

    Names that a catalog can't take are slugged; the authored name stays as a table property. Comments on a table and its columns outlive it, unless another is given."""
    import re

    from ..functions.paths import type_slug

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", database):
        raise ValueError(f"not a database name: {database!r}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    there = _restore(spark, database)
    names = {n: n if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n) else type_slug(n).replace("-", "_") or f"type_{n.encode().hex()}" for n in relations}
    if len(set(map(str.lower, names.values()))) < len(names):
        raise ValueError("two relations have one table name")
    clash = sorted(n for n in names.values() if n.lower() in there)
    if clash and not overwrite:
        raise FileExistsError(f"{database} already has {', '.join(clash)}")
    kept = {n: _comments(spark, f"{database}.{t}") for n, t in names.items() if t.lower() in {x.lower() for x in there}}
    staged = []
    try:
        for name, table in names.items():
            relations[name].write.mode("overwrite").saveAsTable(f"{database}.{table}__new")
            staged.append(table)
    except Exception:
        for table in staged:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{table}__new")
        raise
    counts = {}
    for name, table in names.items():
        at = f"{database}.{table}"
        said, columns = kept.get(name, (None, {}))
        said = (comments or {}).get(name) or said
        spark.sql(f"ALTER TABLE {at}__new SET TBLPROPERTIES ('authored_name' = {_literal(name)})")
        if said:
            spark.sql(f"COMMENT ON TABLE {at}__new IS {_literal(said)}")
        for column, text in columns.items():
            if column in relations[name].columns and "comment" not in relations[name].schema[column].metadata:
                spark.sql(f"ALTER TABLE {at}__new ALTER COLUMN `{column.replace('`', '``')}` COMMENT {_literal(text)}")
        spark.sql(f"DROP TABLE IF EXISTS {at}__old")
        if name in kept:
            spark.sql(f"ALTER TABLE {at} RENAME TO {at}__old")
        spark.sql(f"ALTER TABLE {at}__new RENAME TO {at}")
        spark.sql(f"DROP TABLE IF EXISTS {at}__old")
        counts[name] = spark.table(at).count()
    return counts


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _restore(spark: SparkSession, database: str) -> set[str]:
    """Tables of a database, after those are put back that an export had set aside when it was stopped."""
    there = {t.name for t in spark.catalog.listTables(database) if not t.isTemporary}
    for old in sorted(n for n in there if n.endswith("__old")):
        name = old.removesuffix("__old")
        if name not in there:
            spark.sql(f"ALTER TABLE {database}.{old} RENAME TO {database}.{name}")
            there = there - {old} | {name}
    return there


def _comments(spark: SparkSession, table: str) -> tuple[str | None, dict[str, str]]:
    """A table's comment, and its columns' comments."""
    columns = {c.name: c.description for c in spark.catalog.listColumns(table) if c.description}
    return spark.catalog.getTable(table).description, columns
