"""The engine's functions under SQL names, for ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.exclusion import Exclusion
from . import frontmatter as fm
from . import markdown, paths

FACTS = T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])))])
PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("concept_type", "title", "description", "frontmatter_json", "body", "error")])


def _parse(text: str) -> dict:
    try:
        front, body = fm.required(text)
    except fm.DocumentError as e:
        return {"error": str(e)}
    as_text = lambda k: front.get(k) if isinstance(front.get(k), str) else None
    return {"concept_type": (as_text("type") or "").strip(), "title": as_text("title"), "description": as_text("description"), "frontmatter_json": fm.plain_json(front), "body": body}


def _facts(text: str) -> dict:
    links, headings = markdown.facts(text)
    return {"links": links, "headings": [{"level": n, "text": t} for n, t in headings]}


def _jcs(text: str) -> str | None:
    import json

    def texts(x):
        return {k: texts(v) for k, v in x.items()} if isinstance(x, dict) else [texts(v) for v in x] if isinstance(x, list) else None if x is None else x if isinstance(x, str) else json.dumps(x)

    try:
        return fm.canonical_json(texts(json.loads(text)))
    except ValueError:
        return None


def register(spark: SparkSession) -> list[str]:
    """kb_slug, kb_jcs, kb_parse, kb_markdown_facts, kb_resolve, kb_excluded, and casts kb_try_cast_… written in SQL."""
    one = lambda f: lambda s: s.map(lambda x: None if x is None else f(x))

    @F.pandas_udf(T.StringType())
    def slug(x: pd.Series) -> pd.Series:
        return one(paths.type_slug)(x).astype(object)

    @F.pandas_udf(T.StringType())
    def jcs(x: pd.Series) -> pd.Series:
        return one(_jcs)(x).astype(object)

    @F.pandas_udf(PARSED)
    def parse(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parse(t) if t is not None else {} for t in x], columns=PARSED.names, dtype=object)

    @F.pandas_udf(FACTS)
    def facts(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_facts(t or "") for t in x], columns=FACTS.names, dtype=object)

    @F.pandas_udf(T.StringType())
    def resolve(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([None if None in x else paths.resolve(*x) for x in zip(source, target)], dtype=object)

    @F.pandas_udf(T.BooleanType())
    def excluded(path: pd.Series, patterns: pd.Series) -> pd.Series:
        known: dict[str, Exclusion] = {}
        return pd.Series([known.setdefault(p, Exclusion(p.split("\n"))).excludes(x) for x, p in zip(path, patterns)])

    named = {"kb_slug": slug, "kb_jcs": jcs, "kb_parse": parse, "kb_markdown_facts": facts, "kb_resolve": resolve, "kb_excluded": excluded}
    for name, f in named.items():
        spark.udf.register(name, f)
    number = r"'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_try_cast_bigint(x STRING) RETURNS BIGINT RETURN TRY_CAST(round(TRY_CAST(CASE WHEN x RLIKE {number} THEN trim(x) END AS DECIMAL(38, 10))) AS BIGINT)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION kb_try_cast_date(x STRING) RETURNS DATE RETURN TRY_CAST(CASE WHEN x RLIKE '^\\s*[+-]?\\d+-\\d{1,2}-\\d{1,2}' THEN trim(x) END AS DATE)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kb_try_cast_boolean(x STRING) RETURNS BOOLEAN RETURN CASE WHEN lower(x) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(x) IN ('false', 'f', 'no', 'n', '0') THEN false END")
    return [*named, "kb_try_cast_bigint", "kb_try_cast_date", "kb_try_cast_boolean"]
