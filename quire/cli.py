"""python -m quire.cli COMMAND ROOT …: prints JSON; 0 if all is well, 1 if not, 2 for a request that can't be met."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import service


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Knowledge bundles on Spark.")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("--exclude", action="append", default=[])
        for args, kwargs in options:
            c.add_argument(*args, **kwargs)

    flag = lambda *a: (a, {"action": "store_true"})
    text = lambda *a, **k: (a, k)
    template = text("--spec-template")
    command("check", template, flag("--normative"), text("--relational-schema"), flag("--classification"))
    command("inventory", flag("--digests"))
    command("graph")
    command("schema", text("--kind", choices=["json", "zod", "pydantic", "graphql", "struct"], default="json"), flag("--infer"), text("--cast", action="append", default=[]), template)
    command("format", flag("--write"))
    command("apply", text("--sql", required=True), flag("--write"), template, text("--expected-token"))
    command("import", text("--source", required=True), text("--type", required=True), text("--id-column"), flag("--write"), flag("--overwrite"), text("--on-conflict", default="skip"), text("--expected-token"))
    command("init", text("--template", required=True), flag("--schemas"), flag("--write"))
    command("export", text("--database", required=True), flag("--overwrite"), template)
    return p


def run(spark: SparkSession, argv: list[str]) -> tuple[int, object]:
    a = _parser().parse_args(argv)
    if a.command == "check":
        out = service.check(spark, a.root, a.exclude, a.spec_template, a.normative, a.relational_schema, a.classification)
        return (0 if out["conformant"] else 1), out
    if a.command == "inventory":
        return 0, service.inventory(spark, a.root, a.exclude, a.digests)
    if a.command == "graph":
        return 0, service.graph(spark, a.root, a.exclude)
    if a.command == "schema":
        return 0, service.schema(spark, a.root, a.kind, a.infer, a.cast, a.spec_template, a.exclude)
    if a.command == "format":
        out = service.format_documents(a.root, a.write, a.exclude)
        return (1 if out["skipped_paths"] or (out["changed_paths"] and not a.write) else 0), out
    if a.command == "apply":
        out = service.apply_sql(spark, a.root, a.sql, a.write, a.exclude, a.spec_template, a.expected_token)
        return (1 if out["skipped"] else 0), out
    if a.command == "import":
        out = service.import_rows(spark, a.source, a.root, a.type, a.id_column, a.write, a.overwrite, a.on_conflict, a.expected_token)
        return (1 if out["duplicate_ids"] or out["conflicting_existing"] else 0), out
    if a.command == "init":
        out = service.init(spark, a.root, a.template, a.schemas, a.exclude, a.write)
        return (1 if any(x["collisions"] for x in out.values()) else 0), out
    return 0, service.export(spark, a.root, a.database, a.overwrite, a.spec_template, a.exclude)


def main() -> int:
    spark = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        status, out = run(spark, sys.argv[1:])
    except (ValueError, OSError, KeyError, RuntimeError) as e:
        status, out = 2, {"error": str(e)}
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2))
    return status


if __name__ == "__main__":
    sys.exit(main())
