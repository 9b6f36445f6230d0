"""A bundle as relations: concepts, links, reserved documents and diagnostics."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import frontmatter as fm
from ..functions.markdown import facts
from ..functions.paths import concept_id_column
from ..model import ERROR, LINKS, ValidationReport, Violation
from ..sources.bundle_source import read_bundle
from . import graph, links, rules
from .parse import parse_documents


def concepts_of(parsed: DataFrame) -> DataFrame:
    """Documents that parse; one without a type has an empty one and stays."""
    key = concept_id_column(F.col("path"))
    return parsed.where("not is_reserved and error is null").select(key.alias("concept_id"), key.alias("logical_key"), "path", "concept_type", "title", "description", "source_digest", "parsed_digest", "frontmatter_json", "body")


def reserved_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_reserved and body is not null").select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "body")


@dataclass
class Bundle:
    """Lazy relations over one parsed, persisted DataFrame. ``close`` frees it."""

    root: str
    parsed: DataFrame
    concepts: DataFrame
    links: DataFrame
    reserved: DataFrame
    diagnostics: DataFrame
    views: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, parsed: DataFrame, root: str = "", known: DataFrame | None = None) -> Bundle:
        """known: paths of all discovered documents, if ``parsed`` doesn't have them all."""
        linked = links.link_rows(parsed, parsed.select("path") if known is None else known)
        return cls(root, parsed, concepts_of(parsed), linked.select(*LINKS.names), reserved_of(parsed), rules.in_order(rules.all_rules(parsed, linked)))

    def register(self, prefix: str = "") -> None:
        for name in ("concepts", "links", "reserved", "diagnostics"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
            self.views.append(prefix + name)

    def close(self) -> None:
        for name in self.views:
            self.parsed.sparkSession.catalog.dropTempView(name)
        self.views.clear()
        self.parsed.unpersist()

    @property
    def concept_types(self) -> set[str]:
        return {r[0] for r in self.concepts.select("concept_type").distinct().collect()}

    def inventory(self) -> DataFrame:
        return inventory(self.concepts)

    def summary(self) -> DataFrame:
        return graph.summary(self.concepts.select("concept_id"), links.edges(self.links, self.concepts))

    def counts(self) -> dict[str, int]:
        return {k: getattr(self, k).count() for k in ("concepts", "links", "reserved", "diagnostics")}

    @property
    def is_conformant(self) -> bool:
        return self.diagnostics.where(F.col("severity") == ERROR).isEmpty()

    def validate(self, extra: Iterable[DataFrame] = ()) -> ValidationReport:
        """The report of all rules and of ``extra`` diagnostics, in order."""
        found = rules.in_order(rules.union([self.diagnostics, *extra]))
        violations = tuple(Violation(*r) for r in found.select("code", "severity", "path", "message").collect())
        return ValidationReport(self.root, self.parsed.count(), self.concepts.count(), self.reserved.count(), violations)


def inventory(concepts: DataFrame) -> DataFrame:
    """Concepts by type, the empty type included."""
    return concepts.groupBy("concept_type").agg(F.count("*").alias("n")).orderBy("concept_type")


def load_bundle(spark: SparkSession, root: str, exclude=(), partitions: int | None = None, persist: bool = True) -> Bundle:
    parsed = parse_documents(read_bundle(spark, root, exclude, partitions=partitions))
    return Bundle.of(parsed.persist(StorageLevel.MEMORY_AND_DISK) if persist else parsed, str(root))


def validate_path(spark: SparkSession, root: str, exclude=(), spec_template: str | None = None, normative: bool = False, relational_schema: str | None = None) -> ValidationReport:
    from pathlib import Path

    bundle = load_bundle(spark, root, exclude)
    extra = []
    if relational_schema is not None:
        from ..plans.constraints import load_constraints
        from .relational import check_constraints

        extra.append(check_constraints(bundle.concepts, load_constraints(spark, relational_schema)))
    if spec_template is not None:
        files = [(p.relative_to(root).as_posix(),) for p in Path(root).rglob("*") if p.is_file()]
        extra.append(rules.missing_specs(bundle.concepts, spark.createDataFrame(files, "path string"), spec_template, normative))
    report = bundle.validate(extra)
    bundle.close()
    return report


def classify(spark: SparkSession, root: str, exclude=()) -> DataFrame:
    """path, class: concept, reserved, ignored, or invalid_or_untyped, for every Markdown file below the root."""
    parsed = parse_documents(read_bundle(spark, root, exclude))
    everything = read_bundle(spark, root, capability="identity").select("path")
    return classify_paths(everything, parsed)


def classify_paths(everything: DataFrame, parsed: DataFrame) -> DataFrame:
    own = parsed.select("path", "is_reserved", F.coalesce((F.col("error").isNull()) & (F.col("concept_type") != ""), F.lit(False)).alias("typed"))
    kind = F.when(F.col("is_reserved").isNull(), "ignored").when(F.col("is_reserved"), "reserved").when(F.col("typed"), "concept").otherwise("invalid_or_untyped")
    return everything.join(own, "path", "left").select("path", kind.alias("class"))


ENVELOPE = ("identity", "body", "frontmatter", "markdown_facts", "digests")


def ingest(spark: SparkSession, root: str, capabilities: Iterable[str] = ("identity",), exclude=()) -> DataFrame:
    """Document envelopes in path order. Only the identity: content is never opened."""
    wanted = {"identity", *capabilities}
    if unknown := wanted - set(ENVELOPE):
        raise ValueError(f"unknown capabilities: {sorted(unknown)}")
    if wanted == {"identity"}:
        found = read_bundle(spark, root, exclude, "identity")
        reserved = F.element_at(F.split("path", "/"), -1).isin("index.md", "log.md")
        kind = F.when(F.col("read_error").isNotNull(), "invalid").when(reserved, "reserved").otherwise("candidate")
        return found.select("ordinal", "path", "size", kind.alias("classification"), F.col("read_error").alias("error")).orderBy("ordinal")
    return envelopes(read_bundle(spark, root, exclude), wanted).orderBy("ordinal")


def envelopes(documents: DataFrame, wanted: set[str]) -> DataFrame:
    """documents: ordinal, path, content. Here frontmatter is optional for every document, and the raw type names the class."""
    schema = "ordinal long, path string, size long, classification string, body string, frontmatter string, links array<string>, headings array<struct<level:int,text:string>>, source_digest string, parsed_digest string, error string"

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                row = dict.fromkeys(arrow.names) | {"ordinal": r["ordinal"], "path": r["path"]}
                try:
                    if r["content"] is None:
                        raise fm.DocumentError(r.get("read_error") or "document is missing")
                    raw = r["content"] if isinstance(r["content"], bytes) else r["content"].encode()
                    text = raw.decode()
                    front, body = fm.optional(fm.lf(text))
                    kind = (front or {}).get("type")
                    reserved = r["path"].rpartition("/")[2] in ("index.md", "log.md")
                    row |= {"size": len(raw), "classification": "reserved" if reserved else f"typed:{kind}" if isinstance(kind, str) and kind else "untyped"}
                    if "body" in wanted:
                        row["body"] = body
                    if "frontmatter" in wanted and front is not None:
                        row["frontmatter"] = json.dumps(front, ensure_ascii=False, sort_keys=True)
                    if "markdown_facts" in wanted:
                        row["links"], headings = facts(body)
                        row["headings"] = [{"level": n, "text": t} for n, t in headings]
                    if "digests" in wanted:
                        row["source_digest"] = fm.source_digest(text)
                        row["parsed_digest"] = fm.parsed_digest(front, body) if front is not None else None
                except (fm.DocumentError, UnicodeDecodeError) as e:
                    row |= {"size": None, "classification": "invalid", "error": str(e)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return documents.mapInArrow(run, schema)
