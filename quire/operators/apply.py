"""SQL writes to a bundle's frontmatter: ALTER TABLE steps and one UPDATE, compiled to edits of files.

The statements are read by quire.plans.sqltext; the rows that an UPDATE selects and
the fields that change come from a DataFrame plan (operators.diff).  Only the
changed fields of touched documents come to the driver, which owns the files.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions.paths import fold
from ..model import ERROR, INTERNAL
from ..plans.contract import observations, spelling_collisions, structured_fields
from ..plans.declared import discover as discover_declarations
from ..plans.sqltext import write_script
from ..sources.snapshot import EditError, Snapshot, StaleError, edit_frontmatter, replace_files, same_token, token
from .bundle import Bundle, validate_path
from .diff import ID, Write, WriteError, tampered
from .parse import parse_documents
from .typed import body_lines

PROTECTED = tuple(INTERNAL + c for c in ("path", "concept_id", "logical_key", "body", "body_lines", "frontmatter"))


def write_table(concepts: DataFrame, concept_type: str) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(rows of a type with its scalar fields, ID and field of every authored key, structured fields)."""
    own = concepts.where(F.col("concept_type") == concept_type)
    structured = tuple(sorted(r["field"] for r in structured_fields(own).collect()))
    names = sorted(r["f"] for r in observations(own).where(F.size("path") == 1).select(F.col("path")[0].alias("f")).distinct().collect())
    if bad := [n for n in names if fold(n).startswith(INTERNAL)]:
        raise WriteError(f"a document has a field under the reserved prefix: {bad[0]}")
    if not spelling_collisions(own.sparkSession.createDataFrame([("t", n) for n in names] or [("t", "type")], "concept_type string, field string")).isEmpty():
        raise WriteError("a field is spelled in several ways")
    fields = [n for n in names if fold(n) not in structured]
    entry = F.from_json("frontmatter_json", "map<string,string>")
    columns = [F.col("path").alias(PROTECTED[0]), F.col("concept_id").alias(ID), F.col("logical_key").alias(PROTECTED[2]), F.col("body").alias(PROTECTED[3]), body_lines(F.col("body")).alias(PROTECTED[4]), F.col("frontmatter_json").alias(PROTECTED[5])]
    table = own.select(*columns, *[F.try_element_at(entry, F.lit(n)).alias(n) for n in fields])
    authored = own.select(F.col("concept_id").alias(ID), F.explode(F.json_object_keys("frontmatter_json")).alias("field"))
    return table, authored, structured


def compile_write(concepts: DataFrame, sql: str, declared: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """ID, field, op, value for every field that the script changes."""
    steps, update = write_script(sql)
    by_fold = {fold(r[0]): r[0] for r in concepts.select("concept_type").where("concept_type <> ''").distinct().collect()}
    named = {fold(s.table) for s in steps} | {fold(update.table)}
    if len(named) > 1:
        raise WriteError("a write touches one type")
    if fold(update.table) not in by_fold:
        raise WriteError(f"there is no type {update.table}")
    concept_type = by_fold[fold(update.table)]
    table, authored, structured = write_table(concepts, concept_type)
    write = Write(table, PROTECTED, (declared or {}).get(concept_type, ()), structured)
    for s in steps:
        if s.kind == "add":
            write.add(s.column, s.default)
        elif s.kind == "drop":
            write.drop(s.column)
        else:
            write.rename(s.column, s.new)
    values = {}
    for column, text in update.assignments:
        name = next((c for c in write.frame.columns if fold(c) == fold(column)), None)
        if name is None:
            raise WriteError(f"column {column} does not exist")
        if name in PROTECTED or name in (declared or {}).get(concept_type, ()):
            # allowed only where it changes nothing
            changed = write.frame.where(F.expr(update.where) if update.where else F.lit(True)).where(~F.expr(text).cast("string").eqNullSafe(F.col(name).cast("string")))
            if not changed.isEmpty():
                raise WriteError(f"column {name} is protected")
            continue
        values[name] = F.expr(text).cast("string")
    write.update(F.expr(update.where) if update.where else F.lit(True), **values)
    if not tampered(table, write.rows(), ID, list(PROTECTED)).isEmpty():
        raise WriteError("a write changes what identifies a row")
    return write.row_diff(authored)


def apply_sql(spark: SparkSession, root: str, sql: str, write: bool = False, exclude=(), spec_template: str | None = None, expected_token: str | None = None) -> dict:
    """What a script changes, and with ``write`` the change itself. Documents that can't be edited without loss are named, and then nothing is written."""
    snapshot = Snapshot.take(root, exclude)
    rows = [(p, bytearray(c)) for p, c in snapshot.content.items()]
    parsed = parse_documents(spark.createDataFrame(rows, "path string, content binary")).persist()
    bundle = Bundle.of(parsed, str(root))
    declared = {t: tuple(d.columns) for t, d in discover_declarations(root, bundle.concept_types, spec_template).items()}
    changes: dict[str, dict[str, str | None]] = {}
    where = {r["concept_id"]: r["path"] for r in bundle.concepts.select("concept_id", "path").collect()}
    for r in compile_write(bundle.concepts, sql, declared).collect():
        changes.setdefault(where[r[ID]], {})[r["field"]] = r["value"] if r["op"] == "set" else None
    bundle.close()
    return _finish(spark, snapshot, sql, changes, write, exclude, expected_token)


def _finish(spark, snapshot: Snapshot, operation: str, changes, write: bool, exclude, expected_token) -> dict:
    candidates, skipped = {}, []
    for path, fields in sorted(changes.items()):
        try:
            made = edit_frontmatter(snapshot.content[path], fields)
        except EditError as e:
            skipped.append({"path": path, "reason": str(e)})
            continue
        if made != snapshot.content[path]:
            candidates[path] = made
    result = {"changed": sorted(candidates), "skipped": skipped, "written": False, "preview_token": token(snapshot, operation, candidates)}
    if write and not skipped:
        if expected_token is not None and not same_token(expected_token, result["preview_token"]):
            raise StaleError("the bundle or the write changed since the preview")
        replace_files(snapshot, candidates, lambda r: _errors(spark, r, exclude), exclude)
        result["written"] = True
    return result


def _errors(spark, root: str, exclude) -> set[tuple]:
    return {(v.code, v.path, v.message) for v in validate_path(spark, root, exclude).violations if v.severity == ERROR}


def replace_values(spark: SparkSession, root: str, concept_type: str, field: str, old: str, new: str, **options) -> dict:
    """UPDATE of one value by another."""
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"
    name = lambda s: '"' + s.replace('"', '""') + '"'
    return apply_sql(spark, root, f"UPDATE {name(concept_type)} SET {name(field)} = {text(new)} WHERE {name(field)} = {text(old)}", **options)


def edit_body(spark: SparkSession, root: str, concept_id: str, body: str, expected_source_digest: str | None = None, write: bool = False, exclude=()) -> dict:
    """Another body for one concept; its frontmatter, byte-order mark and line ends stay."""
    snapshot = Snapshot.take(root, exclude)
    path = next((p for p in snapshot.content if p.rpartition(".")[0] == concept_id or p == concept_id), None)
    if path is None:
        raise KeyError(concept_id)
    text = snapshot.content[path].decode()
    if expected_source_digest is not None and fm.source_digest(text) != expected_source_digest:
        raise StaleError(f"{path} isn't what was expected")
    own = fm.split_block(fm.lf(text))
    if own is None:
        raise EditError("document has no frontmatter")
    head = fm.lf(text)[: len(fm.lf(text)) - len(own[1])]
    made = head + fm.lf(body)
    if fm.required(made) != (fm.load_block(own[0]), fm.lf(body)):
        raise EditError("the edit can't be made without loss")
    content = (made.replace("\n", "\r\n") if "\r\n" in text else made).encode()
    candidates = {path: content} if content != snapshot.content[path] else {}
    result = {"path": path, "changed": bool(candidates), "written": False, "source_digest": fm.source_digest(content.decode()), "preview_token": token(snapshot, json.dumps([concept_id, body]), candidates)}
    if write and candidates:
        replace_files(snapshot, candidates, lambda r: _errors(spark, r, exclude), exclude)
        result["written"] = True
    return result


def scaffold(spark: SparkSession, root: str, template: str, with_schemas: bool = False, exclude=(), write: bool = False) -> dict:
    """Specification stubs, and starter declarations, for types that have none: what would be made, or with ``write`` what was. Nothing is overwritten; types that share a path block all files of a kind."""
    from ..functions.paths import declaration_path, spec_path
    from .bundle import load_bundle
    from .typed import starter

    bundle = load_bundle(spark, root, exclude)
    stubs = {t: STUB.format(t) for t in bundle.concept_types if t}
    starters = starter(bundle.concepts) if with_schemas else {}
    bundle.close()
    out = {"specs": _create(root, {t: (spec_path(template, t), text) for t, text in stubs.items()}, write)}
    if with_schemas:
        out["schemas"] = _create(root, {t: (declaration_path(template, t), text) for t, text in starters.items()}, write)
    return out


#: Fixed value: what a specification starts as.
STUB = "---\ntype: Spec\n---\n\n# {}\n\nTODO: describe this type's frontmatter fields and semantics.\n"


def _create(root: str, wanted: Mapping[str, tuple[str | None, str]], write: bool) -> dict:
    """Makes the files that aren't there. wanted: type, with its path (None: it has none) and text."""
    owners: dict[str, list[str]] = {}
    for t, (path, _) in sorted(wanted.items()):
        if path is not None:
            owners.setdefault(path, []).append(t)
    shared = [{"path": p, "types": t} for p, t in sorted(owners.items()) if len(t) > 1]
    missing = [] if shared else sorted(p for p in owners if not (Path(root) / p).is_file())
    for p in missing if write else ():
        target = Path(root) / p
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(wanted[owners[p][0]][1], encoding="utf-8")
    return {"created": missing if write else [], "would_create": [] if write else missing, "collisions": shared, "written": write and not shared}
