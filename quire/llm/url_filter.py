"""URL filter: rules first, else the ratio of two character models.

Rules allow or block a host with its subdomains below a path; the longest that
fits decides.  For other URLs, a smoothed variable-order Markov model of accepted
URLs and one of rejected URLs are compared by their log-likelihoods per character
over all that follows ``://``, the host in lower case, query and fragment included.
They learn from the URLs that rules decide (a bounded sample of each kind, by
hash), and the threshold is the one that errs least, both kinds weighing alike,
on the part of the sample that neither model saw.

Nulls: a URL that is null or has no ``://`` has an empty host and path; no rule
fits it, and one with nothing after ``://`` is allowed.  Where only one kind was met, the others get
its opposite only if a rule says so: all are allowed.  Of rules of one length that
fit, the first in order of text decides.  Rows may repeat; each is judged by itself.
A column of the input that has an output's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .charlm import log_probabilities, variable_order

ORDER = 6
SAMPLE = 4000
LONGEST = 2000
#: The rules of the contract, host and path, and what they say.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null: rules are few, and one array of them is searched."""
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in sorted(rules, key=lambda r: (-len(r[0]), r[0]))])
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.get(fits, F.lit(0))


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """All columns, and host, path, rule, verdict, ratio (log-likelihood difference per character, above 0 for accepted; null where a rule decides), each prefixed ``url_``."""
    fields = pages.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    url = F.col(names[[f.name for f in fields].index(url_col)]).cast("string")
    host, path = host_and_path(url)
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    judged = pages.toDF(*names).withColumn("url_host", host).withColumn("url_path", path).withColumn("url_rest", F.concat("url_host", F.substring(rest, F.length("url_host") + 1, F.length(rest))))
    fits = rule_for(F.col("url_host"), F.col("url_path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    judged = judged.withColumn("url_fits", fits).withColumn("url_rule", F.col("url_fits.rule")).withColumn("url_said", F.col("url_fits.verdict")).drop("url_fits")
    text = F.col("url_rest")
    taught = judged.where("url_said is not null").select("url_said", text.alias("u")).where(F.length("u").between(1, longest))
    number = {r["url_said"]: r["n"] for r in taught.groupBy("url_said").agg(F.approx_count_distinct("u").alias("n")).collect()}
    dice = F.pmod(F.xxhash64("u"), F.lit(1 << 30)) / float(1 << 30)
    learn: dict[str, list[str]] = {}
    for kind in ("allow", "block"):  # about twice the sample is looked at, however many there are
        some = taught.where((F.col("url_said") == kind) & (dice < min(1.0, 2 * sample / max(1, number.get(kind, 1))))).select("u").distinct()
        learn[kind] = [r["u"] for r in some.orderBy(F.xxhash64("u"), "u").limit(sample).collect()]
    scorer = None
    if learn["allow"] and learn["block"]:
        part = {k: (v[::2], v[1::2] or v) for k, v in learn.items()}
        models = [variable_order(part[k][0], ORDER) for k in ("allow", "block")]
        spare = [_ratio(models, part[k][1]) for k in ("allow", "block")]
        scorer = (models, _threshold(*spare))
    shared = pages.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def ratio(u: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.ones(len(u)))
        models, threshold = shared.value
        return pd.Series(_ratio(models, [x or "" for x in u]) - threshold)

    judged = judged.withColumn("url_ratio", F.when(F.col("url_said").isNull(), ratio(text)))
    verdict = F.coalesce("url_said", F.when((F.col("url_ratio") < 0) & (F.length(text) > 0), F.lit("block")).otherwise(F.lit("allow")))
    outs = ["url_host", "url_path", "url_rule", "url_verdict", "url_ratio"]
    return X.named(judged.withColumn("url_verdict", verdict), names, fields, outs, outs)


def _ratio(models, urls: list[str]) -> np.ndarray:
    total, size = log_probabilities(models, urls)
    return (total[:, 0] - total[:, 1]) / np.maximum(size, 1)


def _threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    cuts = np.unique(np.concatenate([accepted, rejected, [0.0]]))
    a, r = np.sort(accepted), np.sort(rejected)
    wrong = np.searchsorted(a, cuts) / len(a) + 1 - np.searchsorted(r, cuts) / len(r)
    best = np.flatnonzero(wrong == wrong.min())
    at = best[np.argmin(np.abs(cuts[best]))]
    return float((cuts[at - 1] + cuts[at]) / 2 if at else cuts[at])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(X.read(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_ratio").alias("ratio"))
