"""Walking a bundle: Markdown files by path components, never through links."""

from __future__ import annotations

import os
from pathlib import Path

from ..functions.paths import is_markdown
from ..model import SKIPPED_DIRECTORIES
from .exclusion import Exclusion


def discover(root: str | Path, rules: Exclusion | None = None) -> list[str]:
    """Bundle paths of all Markdown files, in path order. A directory that rules exclude isn't entered, unless some rule brings things back."""
    root = Path(root).resolve()
    if not root.is_dir():
        raise NotADirectoryError(f"Markdown root is not a directory: {root}")
    rules = rules or Exclusion()
    prune = not rules.has_negation
    found: list[str] = []
    todo = [""]
    while todo:
        base = todo.pop()
        with os.scandir(root / base) as entries:
            for e in entries:
                if e.is_symlink():
                    continue
                path = f"{base}/{e.name}" if base else e.name
                if e.is_dir():
                    if e.name not in SKIPPED_DIRECTORIES and not (prune and rules.excludes(path, True)):
                        todo.append(path)
                elif is_markdown(e.name) and not rules.excludes(path):
                    found.append(path)
    return sorted(found, key=lambda p: p.split("/"))
