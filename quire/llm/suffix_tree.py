"""Substring dedup: word sequences that occur more than once anywhere.

Sparse suffixes (repeats.py) of the corpus, read as words, are split by
variable-length prefixes into groups that fit one worker's memory: a prefix that
too many suffixes share is lengthened.  Each group's suffix tree, its internal
nodes with their string depths and leaves, is built from its sorted suffixes and
their common prefixes; the topmost nodes as deep as a window are its repeats.

Nulls and ties: a null text has no words; repeats within one document count;
every occurrence is removed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import repeats as R

WIDTH = 35
SEED = 12


def prefixes(sample: np.ndarray, groups: int) -> np.ndarray:
    """Where each group of suffixes begins, as prefixes of as many bytes as are needed to make groups of the wanted size."""
    least = max(1, len(sample) // max(1, groups))
    cut: list[bytes] = []

    def split(part: np.ndarray, depth: int, prefix: bytes) -> None:
        if len(part) <= least or depth >= R.LEAD:
            cut.append(prefix)
            return
        keys = np.array([x.ljust(R.LEAD, b"\0")[depth] for x in part.tolist()])
        held = 0
        begin = None
        for value in np.unique(keys):
            rows = part[keys == value]
            child = prefix + bytes([int(value)])
            if len(rows) > least:
                split(rows, depth + 1, child)
                begin, held = None, 0
            elif begin is None or held + len(rows) > least:
                cut.append(child)
                begin, held = child, len(rows)
            else:
                held += len(rows)

    if len(sample):
        split(sample, 0, b"")
    return np.unique(np.array([c for c in cut if c], f"S{R.LEAD}"))


@dataclass(frozen=True)
class Tree:
    """The internal nodes of a suffix tree: string depth, leaves first .. last - 1 (places in the order of the suffixes), and parent (-1: the root's)."""

    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray

    def deep(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, first and last, of the topmost internal nodes of at least ``depth``: each is a string of that length that occurs more than once, and holds all its occurrences."""
        above = np.append(self.depth, -1)[self.parent]
        top = np.flatnonzero((self.depth >= depth) & (above < depth))
        return self.first[top], self.last[top]


def build(common: np.ndarray) -> Tree:
    """The tree over sorted suffixes, from how long a prefix each shares with the one before it: suffixes are added from left to right, the nodes on the way from the root to the last one being open."""
    depth, first, last, parent = [], [], [], []
    opened: list[int] = []
    for i, shared in enumerate([*common[1:].tolist(), 0]):
        begin, child = i, -1
        while opened and depth[opened[-1]] > shared:
            if child >= 0:
                parent[child] = opened[-1]
            child = opened.pop()
            last[child] = i + 1
            begin = first[child]
        if shared and not (opened and depth[opened[-1]] == shared):
            opened.append(len(depth))
            depth.append(shared)
            first.append(begin)
            last.append(-1)
            parent.append(-1)
        if child >= 0 and opened:
            parent[child] = opened[-1]
    return Tree(*(np.array(x, np.int64) for x in (depth, first, last, parent)))


def subtree(spec: R.Repeats, rows, length, off, hot, value) -> np.ndarray:
    """Which windows of a group's suffixes lie under an internal node as deep as a window, or are one suffix met several times."""
    at = np.cumsum(length) - length
    out = np.repeat(value, length)
    order, common = R.multikey(R.window_rows(rows, np.arange(len(off)), off, spec.width))
    first, last = build(common).deep(spec.seed)  # the runs of one anchor
    inner = np.zeros(len(order), bool)
    for a, b in zip(first.tolist(), last.tolist()):
        inner[order[a:b]] = True
    many = np.flatnonzero(inner)
    if len(many):  # below such a node, every window is a suffix of its own
        run, shift = R.expand(length[many])
        flat = at[many][run] + shift
        order, common = R.multikey(R.window_rows(rows[many], run, shift, spec.width))
        first, last = build(common).deep(spec.width)
        leaves = np.append(0, np.cumsum(value[many][run[order]]))
        of = np.repeat(np.arange(len(first)), last - first)
        place = np.arange(len(of)) + (first - np.append(0, np.cumsum(last - first))[:-1])[of]
        out[flat[order[place]]] = (leaves[last] - leaves[first])[of]
    return out > 1


def substring_dedup(docs: DataFrame, text_col: str = "text", width: int = WIDTH, hot_chunks: int = R.HOT_CHUNKS) -> DataFrame:
    """Remove each word covered by ``width`` consecutive words that also occur anywhere else.

    All columns stay; the text becomes the kept words joined by one space where words were removed and is unchanged
    elsewhere.  New columns (prefixed ``dedup_``; columns of those names give way): n_words, n_removed, kept (string: the kept
    words joined by one space).  ``width`` is 16 at least."""
    if width < 16:
        raise ValueError("width must be 16 at least")
    spec = R.Repeats("words", width, SEED, False, hot_chunks)
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at_text = [f.name for f in fields].index(text_col)
    inner = docs.toDF(*names).withColumn(names[at_text], F.col(names[at_text]).cast("string"))
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, inner.schema.fields)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def rewrite(batch, cover, at):
        raw, byte_at = X.text_buffer(batch.column(names[at_text]))
        kept, changed, removed = [], [], []
        some = np.append(0, np.cumsum(cover))
        texts = batch.column(names[at_text])
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            words = raw[byte_at[i] : byte_at[i + 1]].tobytes().split()
            n = int(some[b] - some[a])
            removed.append(n)
            if n:
                words = [w for w, gone in zip(words, cover[a:b].tolist()) if not gone]
            kept.append(b" ".join(words).decode())
            changed.append(kept[-1] if n else texts[i].as_py())
        out = {n: batch.column(n) for n in names} | {names[at_text]: pa.array(changed, pa.string())}
        yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    found = R.covered_rows(inner, spec, names[at_text], None, prefixes, subtree, rewrite, schema)
    return X.named(found, names, fields, ["n_words", "n_removed", "kept"], ["dedup_n_words", "dedup_n_removed", "dedup_kept"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(X.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("dedup_n_words").alias("n_words"), F.col("dedup_n_removed").alias("n_removed"), F.sha2(F.col("dedup_kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], width: int = WIDTH) -> list[tuple]:
    """For tests: (id, words, removed, sha256) by counting every window."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count: dict[tuple, int] = {}
    for w in words:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            count[k] = count.get(k, 0) + 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = bytearray(len(w))
        for p in range(len(w) - width + 1):
            if count[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = b"\1" * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
