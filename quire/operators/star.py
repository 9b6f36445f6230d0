"""A synthetic bundle over the star-schema tables: one Markdown document per row, links along the foreign keys."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import parse_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: Column) -> Column:
    """A YAML scalar in double quotes."""
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))


def document(path: Column, front: dict[str, Column], *body: Column) -> list[Column]:
    lines = [F.concat(F.lit(f"{k}: "), quoted(v)) for k, v in front.items()]
    content = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.concat(*body))
    return [path.alias("path"), content.alias("content")]


def path(folder: str, key: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.col(key).cast("string"), F.lit(".md"))


def _link(label: str, folder: str, key: str) -> Column:
    return F.concat(F.lit(f"[{label}](../{folder}/"), F.col(key).cast("string"), F.lit(".md)\n"))


def star_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    head = lambda c: F.concat(F.lit("# "), F.col(c).cast("string"), F.lit("\n\n"))
    parts = [
        t("region").select(*document(path("region", "r_regionkey"), {"type": F.lit("Region"), "title": F.col("r_name")}, head("r_name"))),
        t("nation").select(*document(path("nation", "n_nationkey"), {"type": F.lit("Nation"), "title": F.col("n_name"), "region": F.col("n_regionkey")}, head("n_name"), _link("region", "region", "n_regionkey"))),
        t("supplier").select(*document(path("supplier", "s_suppkey"), {"type": F.lit("Supplier"), "title": F.col("s_name"), "nation": F.col("s_nationkey")}, head("s_name"), _link("nation", "nation", "s_nationkey"))),
        t("customer").select(*document(path("customer", "c_custkey"), {"type": F.lit("Customer"), "title": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}, head("c_name"), _link("nation", "nation", "c_nationkey"))),
        t("part").select(*document(path("part", "p_partkey"), {"type": F.lit("Part"), "title": F.col("p_name"), "brand": F.col("p_brand")}, head("p_name"))),
        t("orders").select(*document(path("orders", "o_orderkey"), {"type": F.lit("Order"), "title": F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "priority": F.col("o_orderpriority")}, head("o_orderkey"), _link("customer", "customer", "o_custkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_parsed: dict[tuple[int, str], DataFrame] = {}


def star_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once a session and kept, as a bundle is loaded once and then asked."""
    key = (id(spark.sparkContext), sf_dir)
    if key not in _parsed:
        _parsed[key] = parse_documents(star_documents(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    return _parsed[key]
