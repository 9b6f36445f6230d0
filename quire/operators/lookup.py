"""Reading concepts: one by its id, pages, records with links and diagnostics, and lists of relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import links as L

MOST = 1000


def concept(concepts: DataFrame, concept_id: str) -> DataFrame:
    return concepts.where(F.col("concept_id") == concept_id).limit(1)


def find(concepts: DataFrame, reference: str) -> DataFrame:
    """By id first, else by path."""
    hit = concepts.where((F.col("concept_id") == reference) | (F.col("path") == reference))
    return hit.orderBy((F.col("concept_id") != reference), "path").limit(1)


def page(rows: DataFrame, first: int = 50, offset: int = 0, order: str | Sequence[str] = "concept_id", concept_type: str | None = None) -> DataFrame:
    """A page of rows in order; no more than ``offset`` + ``first`` rows a partition ever reach one task."""
    if not 1 <= first <= MOST:
        raise ValueError(f"first must be between 1 and {MOST}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if concept_type is not None:
        rows = rows.where(F.col("concept_type") == concept_type)
    return rows.orderBy(*([order] if isinstance(order, str) else order)).offset(offset).limit(first)


def records(concepts: DataFrame, links: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A page of concepts with links (as written), linked_from and diagnostics, each a list in a defined order; empty lists where there are none.

    Lists are made for the given concepts only; for all of a bundle's, count with links.link_counts instead."""
    own = concepts.select("concept_id").distinct()
    out = L.forward(links.join(own, F.col("source_id") == F.col("concept_id"), "left_semi"))
    back = L.reverse(links.join(own, F.col("target_id") == F.col("concept_id"), "left_semi"))
    said = diagnostics.join(concepts.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("severity", "code", "message"))).alias("diagnostics"))
    made = concepts.join(out, "concept_id", "left").join(back, "concept_id", "left").join(said, "path", "left")
    for c in ("links", "linked_from", "diagnostics"):
        made = made.withColumn(c, F.coalesce(c, F.array().cast(made.schema[c].dataType)))
    return made


def typed_or_raw(has_row: Column, typed: Column, raw: Column) -> Column:
    """Where a typed row exists its value counts, even a null; else what was written."""
    return F.when(has_row, typed).otherwise(raw)


def relations(sources: DataFrame, field: str, concepts: DataFrame, key: str = "resource", concept_type: str | None = None) -> DataFrame:
    """source, position, resource, concept columns: entries of a list of maps under ``field``, in the list's order, each with the concept it names.

    sources: concept_id, frontmatter_json. Entries of another shape, blank resources and unknown targets raise while the query runs."""
    list_json = F.get_json_object("frontmatter_json", f"$['{field}']")
    listed = sources.select(F.col("concept_id").alias("source"), list_json.alias("l")).where("l is not null")
    shaped = F.when(~F.col("l").startswith("["), F.raise_error(F.lit(f"{field} must be a list"))).otherwise(F.col("l"))
    items = listed.select("source", F.posexplode(F.from_json(shaped, "array<string>")).alias("position", "item"))
    resource = F.when(~F.coalesce(F.col("item").startswith("{"), F.lit(False)), F.raise_error(F.lit(f"{field} entries must be maps"))).otherwise(F.get_json_object("item", f"$['{key}']"))
    items = items.withColumn("resource", resource)
    items = items.withColumn("resource", F.when(F.coalesce(F.trim("resource"), F.lit("")) == "", F.raise_error(F.lit(f"{field} entries need a {key}"))).otherwise(F.col("resource")))
    # a path without its suffix is an id; an id is one already
    known = concepts.withColumn("__id", F.col("concept_id"))
    joined = items.withColumn("__id", F.regexp_replace("resource", r"(?i)\.md$", "")).join(known, "__id", "left")
    checked = joined.withColumn("concept_id", F.when(F.col("concept_id").isNull(), F.raise_error(F.concat(F.lit("unknown concept: "), "resource"))).otherwise(F.col("concept_id"))).drop("__id")
    return checked if concept_type is None else checked.where(F.col("concept_type") == concept_type)
