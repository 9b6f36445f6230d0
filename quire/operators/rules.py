"""Validation rules: each makes diagnostics (code, severity, path, message) of relations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import ERROR, WARNING, code

DATE = r"(?U)^\d{4}-\d{2}-\d{2}\z"  # digits of any script look like a date, and then aren't a real one


def rows(df: DataFrame, number: int, message: Column | str, severity: str = ERROR, path: str = "path") -> DataFrame:
    """Diagnostics of one rule for the rows of ``df``."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(code(number)).alias("code"), F.lit(severity).alias("severity"), F.col(path).alias("path"), text.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_order(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("path", "severity", "code", "message")


def has_title(headings: str = "headings") -> Column:
    """Is there a first-level heading with text? ``trim`` of all white space, not of spaces alone."""
    return F.coalesce(F.exists(headings, lambda h: (h["level"] == 1) & h["text"].rlike(r"\S")), F.lit(False))


def document_rules(parsed: DataFrame) -> DataFrame:
    """All rules that look at one document: a list of what it breaks, made in one projection, without a shuffle."""

    def said(number: int, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.struct(F.lit(code(number)).alias("code"), F.lit(ERROR).alias("severity"), F.col("path").alias("path"), text.alias("message"))

    def day(text: Column) -> Column:
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.substring(text, 1, 4) > "0000"), text.try_cast("date"))

    rule = lambda number, when, message: F.when(when, said(number, message))
    name = F.element_at(F.split("path", "/"), -1)
    concept, failed, kept = ~F.col("is_reserved"), F.col("error").isNotNull(), F.col("body").isNotNull()
    index, log = F.col("is_reserved") & kept & (name == "index.md"), F.col("is_reserved") & kept & (name == "log.md")
    front, root = F.col("has_frontmatter"), F.col("path") == "index.md"
    extra = F.size(F.array_except("frontmatter_keys", F.array(F.lit("okf_version")))) > 0
    dates = F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: h["text"])
    days = F.filter(F.transform(dates, day), lambda d: d.isNotNull())
    once = F.array(
        rule(1, concept & failed, F.col("error")),
        rule(2, concept & ~failed & (F.col("concept_type") == ""), "frontmatter must contain a non-empty string type"),
        rule(3, F.col("is_reserved") & failed & ~kept, F.col("error")),
        rule(4, index & failed, F.col("error")),
        rule(4, index & ~failed & front & ~root, "only the bundle-root index.md may contain frontmatter"),
        rule(4, index & ~failed & front & root & extra, "root index.md frontmatter may contain only okf_version"),
        rule(5, index & ~failed & ~has_title(), "index.md must contain at least one level-one section"),
        rule(6, log & failed, F.col("error")),
        rule(6, log & ~failed & front, "log.md must not contain frontmatter"),
        rule(7, log & ~failed & ~has_title(), "log.md must contain a level-one title"),
        rule(9, log & ~failed & (days != F.reverse(F.array_sort(days))), "log date groups must be ordered newest first"),
    )
    shapeless = F.transform(F.filter(dates, lambda t: ~t.rlike(DATE)), lambda t: said(8, F.concat(F.lit("log date heading must use YYYY-MM-DD: "), t)))
    unreal = F.transform(F.filter(dates, lambda t: t.rlike(DATE) & day(t).isNull()), lambda t: said(8, F.concat(F.lit("log date heading is not a real date: "), t)))
    each = F.when(log & ~failed, F.concat(shapeless, unreal)).otherwise(F.array_compact(F.array(rule(8, F.lit(False), ""))))
    return parsed.select(F.explode(F.concat(F.array_compact(once), each)).alias("d")).select("d.*")


def broken_links(links: DataFrame) -> DataFrame:
    return rows(links.where("not exists"), 101, F.concat(F.lit("local Markdown link does not resolve: "), "raw_target"), WARNING)


def missing_specs(types: DataFrame, known: DataFrame, template: str, normative: bool = False) -> DataFrame:
    """types: concept_type. known: path of every file below the bundle. A type without a document, or without a slug for one."""
    paths.spec_path(template, "x")  # an unusable template is an error at once

    @F.pandas_udf("string")
    def expected(name: pd.Series) -> pd.Series:
        return name.map(lambda n: paths.spec_path(template, n)).astype(object)

    severity = ERROR if normative else WARNING
    used = types.select("concept_type").where("concept_type <> ''").distinct().withColumn("path", expected("concept_type"))
    said = lambda end: F.concat(F.lit('type "'), "concept_type", F.lit(end))
    missing = used.where("path is not null").join(known.select("path").distinct(), "path", "left_anti")
    nameless = used.where("path is null").withColumn("path", F.lit(template))
    return rows(missing, 10, said('" has no specification document'), severity).unionByName(rows(nameless, 10, said('" has no slug usable as a document path'), severity))


def all_rules(parsed: DataFrame, links: DataFrame) -> DataFrame:
    return document_rules(parsed).unionByName(broken_links(links))
