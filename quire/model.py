"""Schemas and records shared by all of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Relation schemas, rule codes, prefixes and names that results must carry to equal those of other tools.
CODE = "OKF"
SOURCE_PREFIX = "sha256:"
PARSED_PREFIX = "okf-parsed-v1-jcs-sha256:"
IGNORE_FILE = ".okfignore"
INTERNAL = "__okf_"
RESERVED = ("index.md", "log.md")
SKIPPED_DIRECTORIES = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".ty_cache", ".venv")
ERROR, WARNING = "error", "warning"

_text = T.StringType()


def _schema(required: str, optional: str = "", **other: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, other.get(n, _text), n in optional.split()) for n in required.split()]


CONCEPTS = T.StructType(_schema("concept_id logical_key path concept_type title description source_digest parsed_digest frontmatter_json body", "title description"))
LINKS = T.StructType(_schema("source_id raw_target target_id exists origin", "target_id", exists=T.BooleanType()))
RESERVED_DOCUMENTS = T.StructType(_schema("path filename body"))
DIAGNOSTICS = T.StructType(_schema("code severity path message"))
HEADING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", _text)])

#: What the one parsing stage makes of a document.
PARSED = T.StructType(
    [
        T.StructField("path", _text),
        T.StructField("size", T.LongType()),
        T.StructField("is_reserved", T.BooleanType()),
        T.StructField("error", _text),
        T.StructField("type_raw", _text),
        T.StructField("concept_type", _text),
        T.StructField("title", _text),
        T.StructField("description", _text),
        T.StructField("has_frontmatter", T.BooleanType()),
        T.StructField("frontmatter_keys", T.ArrayType(_text)),
        T.StructField("frontmatter_json", _text),
        T.StructField("body", _text),
        T.StructField("source_digest", _text),
        T.StructField("parsed_digest", _text),
        T.StructField("links", T.ArrayType(_text)),
        T.StructField("headings", T.ArrayType(HEADING)),
    ]
)


def code(number: int) -> str:
    return f"{CODE}{number:03d}"


@dataclass(frozen=True)
class Violation:
    code: str
    severity: str
    path: str
    message: str


@dataclass(frozen=True)
class ValidationReport:
    root: str
    markdown_count: int
    concept_count: int
    reserved_count: int
    violations: tuple[Violation, ...]

    @property
    def is_conformant(self) -> bool:
        return all(v.severity != ERROR for v in self.violations)
