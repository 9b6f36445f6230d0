"""Declared types: what a ``.schema.sql`` beside a specification says about a type's columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.casts import LogicalType, logical_type
from ..functions.paths import declaration_path, fold
from .sqltext import SqlError, tables


class DeclarationError(ValueError):
    """A declaration that can't be used."""


@dataclass(frozen=True)
class Declaration:
    table: str
    columns: dict[str, LogicalType]
    comment: str | None = None
    comments: dict[str, str] = field(default_factory=dict)


def declare(script: str, concept_type: str) -> Declaration:
    """The one table of the type's name (ASCII letters of any case) that the script leaves behind."""
    try:
        found = [t for t in tables(script) if fold(t.name) == fold(concept_type) and not t.temporary]
    except SqlError as e:
        raise DeclarationError(f"declared schema script failed: {e}") from e
    if not found:
        raise DeclarationError(f"declared schema script did not leave behind a table named {concept_type!r}")
    if len(found) > 1:
        raise DeclarationError(f"declared schema script left more than one table named {concept_type!r}")
    t = found[0]
    return Declaration(t.name, {c.name: logical_type(c.type) for c in t.columns}, t.comment, dict(t.comments))


def discover(root: str | Path, types: Iterable[str], template: str | None) -> dict[str, Declaration]:
    """Declarations by type. A missing file is none; one that can't be read or used is an error, as are two types with one path."""
    if template is None:
        return {}
    out, taken = {}, {}
    for name in sorted(t for t in types if t):
        relative = declaration_path(template, name)
        if relative is None:
            continue
        if relative in taken:
            raise DeclarationError(f"types {taken[relative]!r} and {name!r} share the declaration {relative}")
        taken[relative] = name
        path = Path(root) / relative
        if not path.is_file():
            continue
        try:
            script = path.read_bytes().decode()
        except (OSError, UnicodeDecodeError) as e:
            raise DeclarationError(f"cannot read {relative}: {e}") from e
        out[name] = declare(script, name)
    return out


def ddl(table: str, columns: dict[str, str]) -> str:
    """A starter declaration."""
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    body = ",\n".join(f"    {quoted(n)} {t}" for n, t in columns.items())
    return f"CREATE TABLE {quoted(table)} (\n{body}\n);\n" if columns else f"CREATE TABLE {quoted(table)} (\n    {quoted('title')} VARCHAR\n);\n"
