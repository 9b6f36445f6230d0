"""Links: from targets as written to documents, by joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths
from ..model import RESERVED

#: A side of a join is sent to all workers only below this many rows of paths (some ten MB).
BROADCAST_ROWS = 100_000


@F.pandas_udf(StringType())
def resolve_target(source: pd.Series, target: pd.Series) -> pd.Series:
    """The bundle path that a link names, or null. Equal pairs of a batch are resolved once."""
    done: dict[tuple[str, str], str | None] = {}
    out = []
    for key in zip(source, target):
        if key not in done:
            done[key] = None if None in key else paths.resolve(*key)
        out.append(done[key])
    return pd.Series(out, dtype=object)


def bounded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows that it is small; else Spark chooses."""
    return F.broadcast(small) if len(small.limit(limit + 1).select(F.lit(1)).collect()) <= limit else small


def link_rows(parsed: DataFrame, known: DataFrame, broadcast: bool = False) -> DataFrame:
    """source_id, path, raw_target, target_id, exists, origin: one row per link as written (a bag).

    parsed: path, is_reserved, error, links.  known: path of every discovered document, whether it parses or not."""
    links = parsed.where("not is_reserved and error is null").select("path", F.explode("links").alias("raw_target"))
    links = links.withColumn("resolved", resolve_target("path", "raw_target")).where("resolved is not null")
    known = known.select(F.col("path").alias("resolved"), F.lit(True).alias("found")).distinct()
    joined = links.join(bounded(known) if broadcast else known, "resolved", "left")
    exists = F.coalesce("found", F.lit(False))
    reserved = F.element_at(F.split("resolved", "/"), -1).isin(*RESERVED)
    return joined.select(
        paths.concept_id_column(F.col("path")).alias("source_id"),
        "path",
        "raw_target",
        F.when(exists & ~reserved, paths.concept_id_column(F.col("resolved"))).alias("target_id"),
        exists.alias("exists"),
        F.lit("body").alias("origin"),
    )


def edges(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """source, target: links whose target became a concept; parallel links and loops stay."""
    ids = concepts.select(F.col("concept_id").alias("target")).distinct()
    return links.where("target_id is not null").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "raw_target", "origin").join(ids, "target", "left_semi").select("source", "target", "raw_target", "origin")


def forward(links: DataFrame) -> DataFrame:
    """concept_id, links: what each concept links to, in a defined order."""
    item = F.struct("raw_target", "target_id", "exists", "origin")
    return links.groupBy(F.col("source_id").alias("concept_id")).agg(F.array_sort(F.collect_list(item)).alias("links"))


def reverse(links: DataFrame) -> DataFrame:
    """concept_id, linked_from: which concepts link to each."""
    item = F.struct("source_id", "raw_target", "origin")
    return links.where("target_id is not null").groupBy(F.col("target_id").alias("concept_id")).agg(F.array_sort(F.collect_list(item)).alias("linked_from"))


def link_counts(links: DataFrame) -> DataFrame:
    """concept_id, n_links, n_linked_from: counted, so that a target of very many links is a number and no list."""
    both = links.select(F.col("source_id").alias("concept_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.where("target_id is not null").select("target_id", F.lit(0), F.lit(1)))
    return both.groupBy("concept_id").agg(F.sum("o").cast("long").alias("n_links"), F.sum("i").cast("long").alias("n_linked_from"))
