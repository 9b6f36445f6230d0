"""Rows of any table as documents: planned by Spark, one document a row."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql import types as T

from ..functions.frontmatter import DocumentError, required
from ..functions.paths import type_slug

POLICIES = ("skip", "verify-identical")


class ImportFailure(ValueError):
    """An import that can't be planned."""


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """CSV, Parquet, ORC or JSON, by the name's end."""
    end = source.lower().removesuffix(".gz").rpartition(".")[2]
    try:
        if end in ("csv", "tsv"):
            return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if end == "tsv" else ",").csv(source)
        if end in ("parquet", "orc"):
            return spark.read.format(end).load(source)
        if end in ("ndjson", "jsonl"):
            return spark.read.json(source)
        if end == "json":
            return spark.read.option("multiLine", True).json(source)
    except Exception as e:
        raise ImportFailure(f"cannot read {source}: {e}") from e
    raise ImportFailure(f"cannot read {source}: unknown kind of file")


def as_text(field: T.StructField) -> Column:
    """A value as the importer writes it: booleans as True and False, times with a space, other values as Spark writes them."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


@F.pandas_udf(StringType())
def slug(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else type_slug(v)).astype(object)


def plan(rows: DataFrame, concept_type: str, id_column: str | None = None, order: list[str] | None = None) -> DataFrame:
    """slug, path, content. Without an id column rows are numbered in the order of ``order`` (all columns where that is not given): a total sort, which only such imports pay for."""
    names = [f.name for f in rows.schema.fields]
    if "type" in names:
        raise ImportFailure("source column 'type' is reserved; use the concept type to set identity")
    if id_column is not None and id_column not in names:
        raise ImportFailure(f"id column {id_column!r} is not a column of the source: {names}")
    texts = {f.name: as_text(f) for f in rows.schema.fields}
    folder = type_slug(concept_type) or "concept"
    if id_column is None:
        numbered = _numbered(rows, order or [n for n, f in zip(names, rows.schema.fields) if not isinstance(f.dataType, T.MapType)])
        key = F.lpad(F.col("__n").cast("string"), 6, "0")
        own = slug(key)
    else:
        numbered = rows
        raw = texts[id_column]
        key = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.raise_error(F.lit(f"a row has no value in id column {id_column!r}"))).otherwise(raw)
        own = F.coalesce(F.nullif(slug(key), F.lit("")), F.concat(F.lit("row-"), F.substring(F.sha2(key, 256), 1, 12)))
    entries = F.array(*[F.struct(F.lit(n).alias("k"), t.alias("v")) for n, t in texts.items()])

    @F.pandas_udf("string")
    def render(values: pd.Series) -> pd.Series:
        out = []
        for entry in values:
            front = {"type": concept_type} | {e["k"]: e["v"] for e in entry if e["v"] is not None}
            out.append(f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True, width=4096)}---\n")
        return pd.Series(out, dtype=object)

    made = numbered.select(own.alias("slug"), render(entries).alias("content"))
    return made.select("slug", F.concat(F.lit(f"{folder}/"), "slug", F.lit(".md")).alias("path"), "content")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers of a total order, without bringing all rows into one task: positions within range partitions, and offsets of these."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    from .graph import checkpoint

    dealt = checkpoint(dealt)  # the partition ids must not change between the two passes
    parts = dealt.groupBy("__p").agg(F.count("*").alias("__count"), F.min("__i").alias("__first"))
    before = F.sum("__count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a partition
    return dealt.join(F.broadcast(offsets), "__p").withColumn("__n", F.col("__i") - F.col("__first") + F.col("__before")).drop("__p", "__i", "__first", "__before")


def duplicate_slugs(planned: DataFrame) -> DataFrame:
    """slug, n: slugs of several rows; any of them blocks an import."""
    return planned.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def import_rows(spark: SparkSession, source: str, root: str, concept_type: str, id_column: str | None = None, write: bool = False, overwrite: bool = False, on_conflict: str = "skip", expected_token: str | None = None) -> dict:
    """Plan, and with ``write`` carry out, an import into a bundle on the driver's file system. Nothing is written if anything conflicts."""
    if on_conflict not in POLICIES:
        raise ImportFailure(f"unknown conflict policy: {on_conflict}")
    if overwrite and on_conflict == "verify-identical":
        raise ImportFailure("overwrite and verify-identical exclude each other")
    planned = plan(read_table(spark, source), concept_type, id_column).persist()
    result = {k: [] for k in ("created", "would_create", "skipped_existing", "matched_existing", "conflicting_existing", "duplicate_ids")} | {"written": False}
    result["duplicate_ids"] = sorted(r["slug"] for r in duplicate_slugs(planned).collect())
    todo: dict[str, str] = {}
    digest = hashlib.sha256(repr((concept_type, id_column, overwrite, on_conflict)).encode())
    if not result["duplicate_ids"]:
        for r in planned.orderBy("path").toLocalIterator():
            target = Path(root) / r["path"]
            there = target.read_bytes() if target.is_file() else None
            digest.update(repr((r["path"], r["content"], there)).encode())
            if there is None or overwrite:
                todo[r["path"]] = r["content"]
            elif on_conflict == "skip":
                result["skipped_existing"].append(r["path"])
            else:
                result["matched_existing" if _same(there, r["content"]) else "conflicting_existing"].append(r["path"])
    planned.unpersist()
    result["preview_token"] = digest.hexdigest()
    if write and expected_token is not None and expected_token != result["preview_token"]:
        raise ImportFailure("the source or the bundle changed since the preview")
    if write and not result["duplicate_ids"] and not result["conflicting_existing"]:
        for path, content in todo.items():
            target = Path(root) / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(content, encoding="utf-8")
        result |= {"created": sorted(todo), "written": True}
    elif not result["duplicate_ids"]:
        result["would_create"] = sorted(todo)
    return result


def _same(there: bytes, content: str) -> bool:
    try:
        return required(there.decode()) == required(content)
    except (DocumentError, UnicodeDecodeError):
        return False
