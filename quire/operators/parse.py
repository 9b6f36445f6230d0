"""The one parsing stage: documents in, one wide row each out, in Arrow batches.

Everything after it is relational.  Callers that look at the result more than once
persist it; Spark would otherwise run the stage again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import frontmatter as fm
from ..functions.markdown import facts
from ..functions.paths import names_markdown
from ..model import PARSED, RESERVED

_ARROW = to_arrow_schema(PARSED)
_NAMES = [f.name for f in PARSED.fields]


def parse_one(path: str, content: bytes | str | None, read_error: str | None = None) -> dict:
    """A row of PARSED. A document that can't be read or taken apart has an error, and is otherwise empty."""
    reserved = path.rpartition("/")[2] in RESERVED
    row = dict.fromkeys(_NAMES) | {"path": path, "is_reserved": reserved}
    if content is None:
        return row | {"error": read_error or "document is missing"}
    raw = content if isinstance(content, bytes) else content.encode()
    row["size"] = len(raw)
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        return row | {"error": str(e) if reserved else "document must be valid UTF-8"}
    return row | (_reserved(text) if reserved else _concept(text))


def _concept(text: str) -> dict:
    try:
        front, body = fm.required(text)
    except fm.DocumentError as e:
        return {"error": str(e)}
    as_text = lambda k: front.get(k) if isinstance(front.get(k), str) else None
    links, headings = facts(body)
    return {
        "type_raw": as_text("type"),
        "concept_type": (as_text("type") or "").strip(),
        "title": as_text("title"),
        "description": as_text("description"),
        "has_frontmatter": True,
        "frontmatter_keys": list(front),
        "frontmatter_json": fm.plain_json(front),
        "body": body,
        "source_digest": fm.source_digest(text),
        "parsed_digest": fm.parsed_digest(front, body),
        "links": [x for x in links if names_markdown(x)],
        "headings": [{"level": level, "text": t} for level, t in headings],
    }


def _reserved(text: str) -> dict:
    text = fm.lf(text)
    try:
        front, body = fm.optional(text)
    except fm.DocumentError as e:
        return {"error": str(e), "body": text, "has_frontmatter": True}
    _, headings = facts(body)
    return {"has_frontmatter": front is not None, "frontmatter_keys": list(front or ()), "body": body, "headings": [{"level": level, "text": t} for level, t in headings]}


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        errors = b.column("read_error").to_pylist() if "read_error" in b.schema.names else [None] * b.num_rows
        rows = [parse_one(p, c, e) for p, c, e in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), errors)]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def parse_documents(documents: DataFrame) -> DataFrame:
    """documents: path, content (string or binary; null with read_error, if there is such a column)."""
    return documents.mapInArrow(parse_batches, PARSED)
