"""Services that return plain data, for programs and for the command line."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession

from .functions.formatting import format_bundle
from .operators import apply, bundle, imports, typed
from .plans import contract
from .plans.declared import discover


def check(spark: SparkSession, root: str, exclude=(), spec_template: str | None = None, normative: bool = False, relational_schema: str | None = None, classification: bool = False) -> dict:
    report = bundle.validate_path(spark, root, exclude, spec_template, normative, relational_schema)
    out = {"root": report.root, "conformant": report.is_conformant, "markdown_count": report.markdown_count, "concept_count": report.concept_count, "reserved_count": report.reserved_count, "diagnostics": [asdict(v) for v in report.violations]}
    if classification:
        found: dict[str, list[str]] = {k: [] for k in ("concept", "reserved", "ignored", "invalid_or_untyped")}
        for r in bundle.classify(spark, root, exclude).orderBy("path").collect():
            found[r["class"]].append(r["path"])
        out["classification"] = found
    return out


def inventory(spark: SparkSession, root: str, exclude=(), digests: bool = False) -> dict:
    loaded = bundle.load_bundle(spark, root, exclude)
    out = {"root": root, "types": [r.asDict() for r in loaded.inventory().collect()]}
    if digests:
        out["digests"] = [r.asDict() for r in loaded.concepts.select("concept_id", "path", "source_digest", "parsed_digest").orderBy("path").collect()]
    loaded.close()
    return out


def graph(spark: SparkSession, root: str, exclude=()) -> dict:
    loaded = bundle.load_bundle(spark, root, exclude)
    found = loaded.summary().first()
    out = {"root": root, "nodes": found["nodes"], "edges": found["edges"], "weakly_connected_components": found["weak_components"], "strongly_connected_components": found["strong_components"], "directed_acyclic": found["is_dag"]}
    loaded.close()
    return out


def schema(spark: SparkSession, root: str, kind: str = "json", infer: bool = False, casts=(), spec_template: str | None = None, exclude=(), zod_import: str = "zod"):
    loaded = bundle.load_bundle(spark, root, exclude)
    declared = {t: d.columns for t, d in discover(root, loaded.concept_types, spec_template).items()}
    found = contract.contracts(loaded.concepts, infer, casts, declared)
    loaded.close()
    if kind == "json":
        return contract.render_json_schema(found)
    if kind == "zod":
        return contract.render_zod(found, zod_import)
    if kind == "struct":
        return {c.concept_type: contract.struct_type(c.root).jsonValue() for c in found}
    return {"pydantic": contract.render_pydantic, "graphql": contract.render_graphql}[kind](found)


def export(spark: SparkSession, root: str, database: str, overwrite: bool = False, spec_template: str | None = None, exclude=()) -> dict:
    """Relations, and typed tables in a database of their own; tables there that no declaration names are reported, not dropped."""
    loaded = bundle.load_bundle(spark, root, exclude)
    out = {"counts": typed.export(spark, {n: getattr(loaded, n) for n in ("concepts", "links", "reserved", "diagnostics")}, database, overwrite)}
    declarations = discover(root, loaded.concept_types, spec_template)
    if declarations:
        relations = typed.TypedRelations(loaded.concepts, declarations)
        out["types"] = typed.export(spark, {t: relations[t] for t in relations}, f"{database}_types", overwrite, {t: d.comment for t, d in declarations.items() if d.comment})
        known = {spark_name.lower() for spark_name in out["types"]}
        out["unrecognised"] = sorted(t.name for t in spark.catalog.listTables(f"{database}_types") if not t.isTemporary and t.name.lower() not in known and t.name not in {k.replace("-", "_") for k in known})
    loaded.close()
    return out


def format_documents(root: str, write: bool = False, exclude=()) -> dict:
    return asdict(format_bundle(root, write, exclude))


import_rows = imports.import_rows
apply_sql = apply.apply_sql
replace_values = apply.replace_values
edit_body = apply.edit_body
init = apply.scaffold
