"""License scans: template markup compiled to token automata.

A template is plain wording with two kinds of markup: ``[[ ... ]]`` may be left
out, and ``<<name:least-most>>`` stands for any words, so many of them.  It is
compiled into an automaton over words; a text holds the license if the automaton
accepts words that stand consecutively in it, so all mandatory wording has to
match exactly, while optional and replaceable regions may differ.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all other characters
beyond ASCII.  Phrases of the base scan are counted at every place, overlapping
ones too.

All matches of a template that don't overlap are spans, from left to right, each
the shortest that begins where it does.

Nulls: a null text is empty; no words, no labels.  Rows may repeat; each is judged
by itself.  A column of the input that has an output's name gives way to it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import exchange as X

#: The contract's phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Public license wordings (SPDX identifiers in lower case) as templates.
TEMPLATES = (
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0 [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc [[4 0]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa [[4 0]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[international]] license"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "gnu lesser general public license [[version <<version:1-2>>]]"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mit", "[[released]] under the mit license"),
    ("proprietary", "copyright [[c]] [[<<year:1-2>>]] <<holder:1-8>> all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall <<holders:1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and <<author:1-12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall <<author:1-12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
        " arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " [[ [[3]] neither the name of <<holder:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]"
        " this software is provided by <<holders:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means",
    ),
)
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@dataclass(frozen=True)
class Automaton:
    """steps: per state (word, or None for any; next state); skips: moves without a word; needs: wording that every accepted text holds."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]
    final: int
    needs: bytes
    starts: frozenset[bytes]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: Sequence[bytes], at: int) -> int | None:
        """The end of the shortest acceptance that begins at ``at``."""
        states = self.closure({0})
        while True:
            if self.final in states:
                return at
            if at >= len(words):
                return None
            states = self.closure({n for s in states for w, n in self.steps[s] if w is None or w == words[at]})
            if not states:
                return None
            at += 1

    def find(self, words: Sequence[bytes]) -> tuple[int, int] | None:
        return next(self.matches(words), None)

    def matches(self, words: Sequence[bytes]):
        """All matches from left to right, none overlapping the one before."""
        over = 0
        for at, w in enumerate(words):
            if at >= over and w in self.starts and (end := self.accepts(words, at)) is not None:
                yield at, end
                over = end


def compile_template(label: str, markup: str) -> Automaton:
    steps: list[list] = [[]]
    skips: list[list[int]] = [[]]

    def new() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    here, opened, runs, run, depth = 0, [], [], [], 0
    for token in re.findall(r"\[\[|\]\]|<<\w+:\d+-\d+>>|[^\s\[\]<>]+", markup):
        if token == "[[":
            opened.append(here)
            here = _skip(skips, here, new())
            opened.append(here)
            depth += 1
            runs.append(run)
            run = []
        elif token == "]]":
            opened.pop()
            begin = opened.pop()
            out = new()
            skips[here].append(out)
            skips[begin].append(out)
            here, depth = out, depth - 1
        elif token.startswith("<<"):
            least, most = map(int, re.findall(r"\d+", token)[-2:])
            exits = []
            for i in range(most):
                if i >= least:
                    exits.append(here)
                out = new()
                steps[here].append((None, out))
                here = out
            for e in exits:
                skips[e].append(here)
            if depth == 0:
                runs.append(run)
                run = []
        else:
            out = new()
            steps[here].append((token.lower().encode(), out))
            here = out
            if depth == 0:
                run.append(token.lower())
    runs.append(run)
    if depth:
        raise ValueError(f"unclosed [[ in {label}")
    needs = max(runs, key=lambda r: sum(map(len, r)))
    if not needs:
        raise ValueError(f"{label} has no mandatory wording")
    made = Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, skips)), here, " ".join(needs).encode(), frozenset())
    first = made.closure({0})
    if here in first or any(w is None for s in first for w, _ in steps[s]):
        raise ValueError(f"{label} has to begin with wording")
    return Automaton(made.label, made.steps, made.skips, made.final, made.needs, frozenset(w for s in first for w, _ in steps[s]))


def _skip(skips: list[list[int]], a: int, b: int) -> int:
    skips[a].append(b)
    return b


@functools.lru_cache(8)
def automata(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(compile_template(*t) for t in templates)


def scan(text: bytes, phrases, machines: Sequence[Automaton]):
    """(words, base places, first, last, base labels, labels, score, spans) of a text."""
    words = text.translate(_TABLE).split()
    if not words:
        return 0, 0, None, None, [], [], 0.0, []
    joined = b" " + b" ".join(words) + b" "
    count, first, last, base = 0, None, None, set()
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        if at < 0:
            continue
        base.add(label)
        low = joined.count(b" ", 0, at)
        first = low if first is None else min(first, low)
        while at >= 0:
            count += 1
            end, at = at, joined.find(wanted, at + 1)
        high = joined.count(b" ", 0, end)
        last = high if last is None else max(last, high)
    labels, spans = set(base), []
    for m in machines:
        if m.needs in joined:
            spans += [{"label": m.label, "first": a, "end": b} for a, b in m.matches(words)]
    labels |= {x["label"] for x in spans}
    spans.sort(key=lambda x: (x["first"], x["end"], x["label"]))
    return len(words), count, first, last, sorted(base), sorted(labels), 1.0 if spans else 0.5 if base else 0.0, spans


def license_scan(df: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, out: str = "license_") -> DataFrame:
    """All columns, and ``out`` + n_words, n_base, first_word, last_word, base_labels, labels (arrays of strings), score, spans (template matches in words)."""
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at = [f.name for f in fields].index(text_col)
    inner = df.toDF(*names)
    more = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,first:long,end:long>>"
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, inner.schema.fields)] + T.StructType.fromDDL(more).fields)
    templates = tuple(map(tuple, templates))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        machines = automata(templates)
        for whole in batches:
            for b in X.slices(whole, names[at], 4 * X.CHUNK_BYTES):
                raw, cut = X.text_buffer(b.column(names[at]))
                data = raw.tobytes()
                found = [scan(data[i:j], phrases, machines) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + columns, names=schema.names)

    outs = T.StructType.fromDDL(more).names
    return X.named(X.arrow(inner).mapInArrow(run, schema), names, fields, outs, [out + o for o in outs])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = license_scan(X.read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.concat_ws(",", f"license_{c}").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", *[F.col(f"license_{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")], *joined, F.col("license_score").alias("score"))
