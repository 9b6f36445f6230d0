"""Suffix-array dedup: byte strings that a smaller document already holds.

Sparse suffixes (repeats.py) are range-partitioned by their leading bytes at
sampled splitters; every bucket sorts its suffixes by multikey quicksort and
compares neighbours.  A splitter cuts on the 24 bytes that all suffixes of an
anchor share, so that equal windows, whichever side of a splitter they lie on
as text, meet in one bucket and no comparison is lost at a boundary.

Nulls and ties: a null text is empty; a null id counts as larger than any other;
documents with one id never remove each other's bytes; matches never cross
documents.  An empty table gives an empty result.  Other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import repeats as R

WIDTH = 50
SEED = 24


def splitters(sample: np.ndarray, buckets: int) -> np.ndarray:
    """Quantiles of the sample."""
    if not len(sample):
        return np.zeros(0, f"S{R.LEAD}")
    return np.unique(sample[(np.arange(1, buckets) * len(sample)) // buckets])


def sort_bucket(spec: R.Repeats, rows, length, off, hot, value) -> np.ndarray:
    return R.bucket_windows(spec, rows, length, off, hot, value, R.multikey, spec.seed // 8)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot_chunks: int = R.HOT_CHUNKS) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts in a document with a smaller id.

    Returns id, kept (binary: the remaining bytes), n_bytes, n_removed and spans (array of struct<start, end>, maximal removed runs)
    for every row.  ``width`` is 40 at least."""
    if width < 40:
        raise ValueError("width must be 40 at least")
    spec = R.Repeats("bytes", width, SEED, True, hot_chunks)
    schema = "id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"

    def rewrite(batch, cover, at):
        raw, _ = X.text_buffer(batch.column("text"))
        kept, total, removed, spans = [], [], [], []
        some = np.append(0, np.cumsum(cover))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            n = int(some[b] - some[a])
            total.append(b - a)
            removed.append(n)
            if n:
                c = cover[a:b]
                kept.append(raw[a:b][~c].tobytes())
                edge = np.flatnonzero(np.diff(c, prepend=False, append=False))
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
            else:
                kept.append(raw[a:b].tobytes())
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return R.covered_rows(rows, spec, "text", "id", splitters, sort_bucket, rewrite, schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup(X.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """For tests: (id, bytes, removed, spans, sha256) by looking at every string of ``width`` bytes."""
    last = 1 << 63
    seen: dict[bytes, int] = {}
    texts = [((last if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = min(seen.get(b[p : p + width], last + 1), i)
    out = []
    for (i, b), (own, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
