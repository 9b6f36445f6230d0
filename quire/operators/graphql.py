"""Read queries in GraphQL's text form over a bundle: ``concept(id)`` and ``concepts(type, first, offset)``.

A query is planned as one page of concepts with their links and diagnostics; only
that page, of a thousand concepts at most, comes to the driver.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..model import INTERNAL
from ..plans import contract
from . import lookup
from .bundle import Bundle
from .typed import TypedRelations

_TOKEN = re.compile(r'(?P<skip>[\s,]+|#[^\n]*)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[_A-Za-z]\w*)|(?P<sign>\.\.\.|[{}()\[\]:$!=@])')
#: Fields of every concept, by their names in queries.
FIELDS = {"id": "concept_id", "logicalKey": "logical_key", "path": "path", "type": "concept_type", "title": "title", "description": "description", "body": "body", "sourceDigest": "source_digest", "parsedDigest": "parsed_digest"}


class QueryError(ValueError):
    """A query that can't be read or answered."""


@dataclass
class Selection:
    name: str
    alias: str
    arguments: dict
    fields: list[Selection] = field(default_factory=list)
    on: str | None = None


def parse(query: str) -> list[Selection]:
    found, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None:
            raise QueryError(f"unexpected {query[at]!r}")
        if m.lastgroup != "skip":
            found.append((m.lastgroup, m[0]))
        at = m.end()
    found.append(("end", ""))
    i = 0

    def take(sign: str) -> bool:
        nonlocal i
        if found[i][1] == sign and found[i][0] != "text":
            i += 1
            return True
        return False

    def need(sign: str) -> None:
        if not take(sign):
            raise QueryError(f"expected {sign!r}, not {found[i][1]!r}")

    def name() -> str:
        nonlocal i
        if found[i][0] != "name":
            raise QueryError(f"expected a name, not {found[i][1]!r}")
        i += 1
        return found[i - 1][1]

    def value():
        nonlocal i
        if take("$"):
            return Variable(name())
        if take("["):
            out = []
            while not take("]"):
                out.append(value())
            return out
        kind, text = found[i]
        i += 1
        if kind == "text":
            return json.loads(text)
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, text)
        raise QueryError(f"unexpected {text!r}")

    def selections() -> list[Selection]:
        need("{")
        out = []
        while not take("}"):
            if take("..."):
                need("on")
                kind = name()
                out.append(Selection("...", "...", {}, selections(), kind))
                continue
            own = alias = name()
            if take(":"):
                own = name()
            arguments = {}
            if take("("):
                while not take(")"):
                    key = name()
                    need(":")
                    arguments[key] = value()
            out.append(Selection(own, alias, arguments, selections() if found[i][1] == "{" else []))
        return out

    if found[i][1] != "{":
        if name() != "query":
            raise QueryError("only queries are answered")
        if found[i][0] == "name":
            name()
        if take("("):
            while not take(")"):
                i += 1
                if found[i][0] == "end":
                    raise QueryError("variables aren't closed")
    out = selections()
    if found[i][0] != "end":
        raise QueryError("only one operation is answered")
    return out


@dataclass(frozen=True)
class Variable:
    name: str


def json_ready(value):
    """A value as JSON can hold it: no NaN; decimals, identifiers, days and times as texts."""
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (decimal.Decimal, uuid.UUID)):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, Row):
        return json_ready(value.asDict())
    if isinstance(value, Mapping):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


class ReadAdapter:
    """Queries over one bundle; typed relations, where there are any, give a field's value, even a null.

    With contracts, types and fields go by the names of ``sdl()`` and others are refused; without, by their authored names, and a field that a document lacks is null."""

    def __init__(self, bundle: Bundle, typed: TypedRelations | None = None, contracts: Sequence[contract.Contract] | None = None):
        self.bundle, self.typed, self.contracts = bundle, typed, contracts
        self._types = contract.graphql_types(contracts or ())
        self._fields = {c.concept_type: {shown: own for own, shown in contract.graphql_fields(c).items()} for c in contracts or ()}

    def sdl(self) -> str:
        return contract.render_graphql(self.contracts or ())

    def execute(self, query: str, variables: Mapping | None = None) -> dict:
        """data and errors, ready for JSON."""
        data, errors = {}, []
        try:
            wanted = parse(query)
        except QueryError as e:
            return {"data": None, "errors": [str(e)]}
        for s in wanted:
            try:
                data[s.alias] = self._root(s, variables or {})
            except (ValueError, KeyError) as e:
                data[s.alias] = None
                errors.append(str(e))
        return {"data": data, "errors": errors}

    def _root(self, s: Selection, variables: Mapping):
        given = {k: variables.get(v.name) if isinstance(v, Variable) else v for k, v in s.arguments.items()}
        if s.name == "__typename":
            return "Query"
        if s.name == "concept":
            if not isinstance(given.get("id"), str):
                raise QueryError("concept needs an id")
            found = self._records(lookup.concept(self.bundle.concepts, given["id"]), s)
            return found[0] if found else None
        if s.name == "concepts":
            return self._records(lookup.page(self.bundle.concepts, given.get("first", 50), given.get("offset", 0), concept_type=given.get("type")), s)
        raise QueryError(f"there is no field {s.name!r}")

    def _records(self, page: DataFrame, s: Selection) -> list[dict]:
        asked = {f.name for f in s.fields} | {g.name for f in s.fields for g in f.fields if f.on}
        nested = asked & {"links", "reverseLinks", "diagnostics"}
        rows = (lookup.records(page, self.bundle.links, self.bundle.diagnostics) if nested else page).orderBy("concept_id").collect()
        typed = self._typed_rows(rows)
        return [self._record(r, s, typed.get(r["path"])) for r in rows]

    def _typed_rows(self, rows: list[Row]) -> dict[str, dict]:
        """path: typed row, by one query a type of the page."""
        key, out = INTERNAL + "path", {}
        for t in sorted({r["concept_type"] for r in rows} & set(self.typed or ())):
            paths = [r["path"] for r in rows if r["concept_type"] == t]
            out |= {r[key]: r.asDict() for r in self.typed[t].where(F.col(key).isin(paths)).collect()}
        return out

    def _record(self, row: Row, s: Selection, typed: dict | None) -> dict:
        kind = row["concept_type"]
        shown = self._types.get(kind, kind)
        front = json.loads(row["frontmatter_json"])
        out = {}
        for f in s.fields:
            if f.on is not None:
                if f.on in ("Concept", shown):
                    out |= self._record(row, f, typed)
            elif f.name == "__typename":
                out[f.alias] = shown or "concept"
            elif f.name in FIELDS:
                out[f.alias] = row[FIELDS[f.name]]
            elif f.name == "frontmatter":
                out[f.alias] = front
            elif f.name in ("links", "reverseLinks", "diagnostics"):
                out[f.alias] = [_nested(item, f) for item in _items(row, f.name)]
            else:
                own = f.name if self.contracts is None else self._fields.get(kind, {}).get(f.name)
                if own is None:
                    raise QueryError(f"there is no field {f.name!r} on {shown!r}")
                out[f.alias] = json_ready(typed[own] if typed is not None and own in typed else front.get(own))
        return out


def _items(row: Row, name: str) -> list[dict]:
    """Links, reverse links or diagnostics of a concept, as queries name their parts."""
    me = row["concept_id"]
    if name == "links":
        return [{"sourceId": me, "rawTarget": x["raw_target"], "targetId": x["target_id"], "exists": x["exists"], "origin": x["origin"]} for x in row["links"]]
    if name == "reverseLinks":
        return [{"sourceId": x["source_id"], "rawTarget": x["raw_target"], "targetId": me, "exists": True, "origin": x["origin"]} for x in row["linked_from"]]
    return [{"code": x["code"], "severity": x["severity"], "path": row["path"], "message": x["message"]} for x in row["diagnostics"]]


def _nested(item: dict, s: Selection) -> dict:
    if unknown := [g.name for g in s.fields if g.name not in item]:
        raise QueryError(f"there is no field {unknown[0]!r}")
    return {g.alias: json_ready(item[g.name]) for g in s.fields}
