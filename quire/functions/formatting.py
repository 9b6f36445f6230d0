"""Canonical Markdown for what can be made so without changing what a document says.

Bullets become ``- item``; ordered lists are numbered on from their first number;
headings and rules get one spelling; trailing spaces (but hard breaks) and runs of
blank lines go.  Frontmatter, code, HTML, tables and quotes stay as they are.  A
document whose structure would read differently afterwards is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.discovery import discover
from ..sources.exclusion import Exclusion
from . import markdown as md
from .frontmatter import split_block

_BULLET = re.compile(r"( {0,3})([-+*])( {1,4})(?=\S)")
_ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])( {1,4})(?=\S)")


def _head(text: str) -> tuple[str, str]:
    parts = split_block(text)
    return ("", text) if parts is None else (text[: len(text) - len(parts[1])], parts[1])


def format_markdown(text: str) -> str:
    head, body = _head(text)
    lines = body.split("\n")
    out: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if m := md.FENCE.match(line):
            mark = m[1]
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            out.append(line)
            i += 1
            while i < len(lines):
                out.append(lines[i])
                i += 1
                if end.match(lines[i - 1]):
                    break
        elif line.startswith(("    ", "\t", ">", "<", "|")):
            out.append(line)
            i += 1
        elif (m := md.ATX.match(line)) and line.strip():
            content = "" if m[2] is None or re.fullmatch("#+", m[2]) else m[2].strip()
            out.append(f"{m[1]} {content}".rstrip())
            i += 1
        elif _BULLET.match(line) or _ORDERED.match(line):
            i = _list(lines, i, out)
        else:
            hard = line.endswith("  ") and line.strip() and i + 1 < len(lines) and lines[i + 1].strip()
            out.append(line.rstrip() + ("  " if hard else ""))
            i += 1
    kept: list[str] = []
    code = None
    for line in out:  # one blank line is enough, but for those in code
        if m := md.FENCE.match(line):
            code = None if code and m[1].startswith(code) else code or m[1]
        if line or code or not kept or kept[-1] or line.startswith("    "):
            kept.append(line)
    return head + "\n".join(kept).rstrip("\n") + ("\n" if "".join(kept).strip() else "")


def _list(lines: list[str], i: int, out: list[str]) -> int:
    """A list of one kind of marker, from its first line on."""
    ordered = _ORDERED.match(lines[i])
    pattern = _ORDERED if ordered else _BULLET
    kind = (ordered or _BULLET.match(lines[i]))[3 if ordered else 2]
    number = int(ordered[2]) if ordered else 0
    while i < len(lines):
        m = pattern.match(lines[i])
        if not m or m[3 if ordered else 2] != kind or md.RULE.match(lines[i]):
            break
        old = m.end()
        marker = f"{number}{kind} " if ordered else f"{kind if kind != '*' else '-'} "
        out.append(marker + lines[i][old:].rstrip())
        number += 1
        i += 1
        while i < len(lines) and (not lines[i].strip() or lines[i].startswith(" " * old)):
            if not lines[i].strip() and not any(x.startswith(" " * old) or pattern.match(x) for x in lines[i + 1 : i + 2]):
                break
            out.append(" " * len(marker) + lines[i][old:] if lines[i].strip() else "")
            i += 1
    return i


def signature(text: str) -> tuple:
    """What formatting must not change: frontmatter, headings, links, and code as it stands."""
    head, body = _head(text)
    links, headings = md.facts(body)
    code, inside = [], None
    for line in body.split("\n"):
        if m := md.FENCE.match(line):
            inside = None if inside and m[1].startswith(inside) else inside or m[1]
            code.append(line)
        elif inside:
            code.append(line)
    return head, tuple(links), tuple(headings), tuple(code), len(re.findall(r"\w+", re.sub(r"^\s*\d+[.)]", "", body, flags=re.M)))


def canonical(text: str) -> str | None:
    """The formatted text, or None where formatting isn't safe."""
    made = format_markdown(text)
    return made if signature(made) == signature(text) and format_markdown(made) == made else None


@F.pandas_udf(StringType())
def format_column(text: pd.Series) -> pd.Series:
    """Formatted where that is safe, else as it is."""
    return text.map(lambda t: None if t is None else canonical(t) or t).astype(object)


@dataclass(frozen=True)
class FormatReport:
    markdown_count: int
    changed_paths: tuple[str, ...]
    skipped_paths: tuple[str, ...]
    written: bool

    @property
    def ok(self) -> bool:
        return not self.skipped_paths and (self.written or not self.changed_paths)


def format_bundle(root: str, write: bool = False, exclude=()) -> FormatReport:
    """All documents are formatted before any is written."""
    base = Path(root).resolve()
    paths = discover(base, Exclusion.read(base, exclude))
    skipped, pending = [], {}
    for p in paths:
        try:
            text = (base / p).read_bytes().decode()
        except (OSError, UnicodeDecodeError):
            skipped.append(p)
            continue
        made = canonical(text)
        if made is None:
            skipped.append(p)
        elif made != text:
            pending[p] = made
    if write:
        for p, text in pending.items():
            (base / p).write_text(text, encoding="utf-8")
    return FormatReport(len(paths), tuple(sorted(pending)), tuple(skipped), write)
