"""LM scoring by deleted interpolation.

Maximum-likelihood estimates of word bigrams and unigrams and a uniform share are
mixed; the weights depend on how often the context was met (in buckets of powers
of two) and are learned by expectation-maximisation on held-out counts: each
token of the training texts is predicted from all counts but its own (it is
deleted from them), so that every training token is held out once.

Counting covers all training texts: every chunk of documents asks, per bucket of
the key space, how often its words and pairs of words occur, giving its own
counts; nothing travels as a row per word.  The evidence for the weights is a
histogram whose cells grow with the logarithm of the training tokens: contexts by
powers of two, estimates by half powers of two down to one token in all.

Words are told apart by 64-bit hashes; pairs by hashes that grow with the input.
A column of the input that has an output's name gives way to it.

Nulls: a null text is empty, that is, one end token.  A null id counts as an
empty one (it is trained on).  Without training texts the score is that of the
uniform share over one word.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import repeats as R
from .language_id import fold

U = np.uint64
END = R.mix(np.array([0x656E64], U))[0]
BEGIN = R.mix(np.array([0x626567], U))[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(batch: pa.RecordBatch, text: str):
    """(token hashes, the end after each text included; first token of each row; pair hashes)"""
    raw, at = X.text_buffer(batch.column(text))
    raw = _LOWER[raw]
    starts, ends, first = R.words_of(raw, at)
    rows = len(at) - 1
    t = np.empty(len(starts) + rows, U)
    row = np.repeat(np.arange(rows), np.diff(first))
    place = np.arange(len(starts)) + row
    t[place] = R.word_hashes(raw, starts, ends)
    first = first + np.arange(rows + 1)
    t[first[1:] - 1] = END
    before = np.empty(len(t), U)
    before[1:] = t[:-1]
    before[first[:-1]] = BEGIN
    with np.errstate(over="ignore"):
        pairs = R.mix(before * U(0x9E3779B97F4A7C15) ^ (t + U(0x7F4A7C15)))
    return t, before, pairs, first


def _trained(batch: pa.RecordBatch, name: str, first: np.ndarray) -> np.ndarray:
    return np.repeat(batch.column(name).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))


def _count(keys: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of each are in use."""
    own, of = np.unique(keys, return_inverse=True)
    return own, np.bincount(of[use], minlength=len(own)).astype("<u4")


def _kinds(batch, text: str, trained: str, bits: int):
    """Keys and own counts of words and of pairs. A word begins as many pairs as there are of it, as each is followed by another or the end; rows begin as often as they end."""
    t, before, pairs, first = _tokens(batch, text)
    use = _trained(batch, trained, first)
    return (_count(t, use), _count(pairs >> U(64 - bits), use)), (t, before, pairs, first, use)


def _parts(keys: np.ndarray, buckets: int, bits: int) -> list[int]:
    return [0, *np.searchsorted(keys, R._bounds(buckets, bits)).tolist(), len(keys)]


def _ask(text: str, trained: str, buckets: int, bits: int):
    def ask(batch):
        kinds, _ = _kinds(batch, text, trained, bits)
        cuts = [_parts(k, buckets, w) for (k, _), w in zip(kinds, (64, bits))]
        for b in range(buckets):
            blob = []
            for (keys, counts), cut in zip(kinds, cuts):
                a, z = cut[b], cut[b + 1]
                blob += [X.pack_planes(np.diff(keys[a:z], prepend=U(0))), X.pack_planes(counts[a:z])]
            if any(blob):
                yield b, np.array([len(x) for x in blob], "<i8").tobytes() + b"".join(blob)

    return ask


def _split(blob: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(blob, "<i8", n)
    at = 8 * n + np.append(0, np.cumsum(sizes))
    return [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _reply(blobs: list[bytes]) -> list[bytes]:
    """For each asking chunk, the corpus counts of its keys; the first one's also says how many tokens and distinct words the bucket holds."""
    asked = [_split(b, 4) for b in blobs]
    out: list[list[bytes]] = [[] for _ in blobs]
    tokens = distinct = 0
    for kind in range(2):
        keys = [np.cumsum(X.unpack_planes(a[2 * kind], "<u8")) for a in asked]
        every = np.concatenate(keys)
        counts = np.concatenate([X.unpack_planes(a[2 * kind + 1], "<u4") for a in asked]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        key = every[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts
        if kind == 0:
            tokens, distinct = int(total.sum()), int((total > 0).sum())
        full = np.empty(len(every), np.int64)
        full[order] = np.repeat(total, np.diff(np.append(starts, len(key))))
        cut = np.cumsum([0, *map(len, keys)])
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            out[i].append(X.pack_planes(full[a:b]))
    head = np.array([tokens, distinct], "<i8").tobytes()
    return [(head if i == 0 else b"") + np.array([len(x) for x in o], "<i8").tobytes() + b"".join(o) for i, o in enumerate(out)]


def _answer(asked: DataFrame) -> DataFrame:
    """As exchange.answer; a row of chunk -1 per bucket has its tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("chunk_id").to_numpy(), kind="stable")))
        found = _reply([x.as_py() for x in table.column("data")])
        head, found[0] = found[0][:16], found[0][16:]
        ids, buckets = table.column("chunk_id").to_pylist(), table.column("bucket").to_pylist()
        return pa.Table.from_batches([X.row_batch(ids + [-1], 2, buckets + buckets[:1], found + [head])])

    return asked.groupBy("bucket").applyInArrow(run, X.CHUNK_SCHEMA)


def _corpus_counts(batch, got, text: str, trained: str, bits: int):
    """Per token: its count c, its context's, its pair's, and whether it is a training token."""
    kinds, (t, before, pairs, first, use) = _kinds(batch, text, trained, bits)
    replies = [_split(got[b], 2) for b in sorted(got)]
    (words, _), (pair_keys, _) = kinds
    word, pair = (np.concatenate([X.unpack_planes(r[k], "<i8") for r in replies]) for k in range(2))
    before = np.where(before == BEGIN, END, before)
    return word[np.searchsorted(words, t)], word[np.searchsorted(words, before)], pair[np.searchsorted(pair_keys, pairs >> U(64 - bits))], first, use


@dataclass(frozen=True)
class Grid:
    """The cells of the evidence for so many training tokens."""

    contexts: int  #: buckets of context counts, by powers of two
    levels: int  #: of an estimate, by half powers of two; 0: none

    @classmethod
    def of(cls, tokens: int) -> Grid:
        size = max(2, tokens).bit_length()
        return cls(size + 1, 2 * size + 2)

    def bucket(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(self.contexts - 1, np.frexp(n.astype(np.float64))[1])

    def level(self, p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(self.levels - 1 + np.round(2 * np.log2(np.maximum(p, 1e-300))), 1, self.levels - 1), 0).astype(np.int64)

    def estimate(self, level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, 2.0 ** ((level - (self.levels - 1)) / 2), 0.0)

    def cell(self, bucket: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (bucket * self.levels + self.level(pair)) * self.levels + self.level(word)


def learn_weights(grid: Grid, cells: np.ndarray, number: np.ndarray, uniform: float, steps: int = 60) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket of contexts, by expectation-maximisation over the evidence."""
    bucket, pair, word = cells // grid.levels**2, cells // grid.levels % grid.levels, cells % grid.levels
    p = np.stack([grid.estimate(pair), grid.estimate(word), np.full(len(cells), uniform)], axis=1)
    weights = np.full((grid.contexts, 3), 1 / 3)
    for _ in range(steps):
        share = weights[bucket] * p
        share *= (number / share.sum(axis=1))[:, None]
        total = np.zeros_like(weights)
        np.add.at(total, bucket, share)
        total += 1e-3  # a bucket that was never met shares evenly, and no weight is nought
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def score_texts(df: DataFrame, train: Column, text_col: str = "text", out: str = "lm_") -> DataFrame:
    """All columns, and ``out`` + n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text).

    train: a boolean column (null: false) that says which rows are learned from."""
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    text = names[[f.name for f in fields].index(text_col)]
    inner = df.select("*", F.coalesce(train, F.lit(False)).alias("learn")).toDF(*names, "learn").withColumn(text, F.col(text).cast("string"))
    chunks, _, n_bytes = X.make_chunks(inner, text)
    buckets, bits = X.bucket_count(n_bytes), min(64, math.ceil(math.log2(max(n_bytes, 2))) + 16)
    counts = X.checkpoint(_answer(X.scatter(chunks, _ask(text, "learn", buckets, bits))))
    tokens = distinct = 0
    for row in counts.where("chunk_id = -1").select("data").collect():  # a row per bucket
        n, v = np.frombuffer(row[0], "<i8").tolist()
        tokens, distinct = tokens + n, distinct + v
    counts = counts.where("chunk_id >= 0")
    uniform = 1.0 / (distinct + 1)
    grid = Grid.of(tokens)

    def evidence(batch, got, chunk_id):
        word, context, pair, _, use = _corpus_counts(batch, got, text, "learn", bits)
        word, context, pair = word[use], context[use], pair[use]
        cell = grid.cell(grid.bucket(context - 1), (pair - 1) / np.maximum(context - 1, 1), (word - 1) / max(tokens - 1, 1))
        own, number = np.unique(cell, return_counts=True)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int64()), "n": pa.array(number, pa.int64())})

    # at most contexts * levels ** 2 cells come to the driver: 400,000 for 10 ** 13 tokens
    seen = X.once(X.absorb(chunks, counts, evidence, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))).collect()
    weights = learn_weights(grid, np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.float64), uniform)
    more = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, inner.schema.fields)] + more)

    def score(batch, got, chunk_id):
        word, context, pair, first, _ = _corpus_counts(batch, got, text, "learn", bits)
        base = np.log10((word + 1) / (tokens + distinct + 1))
        w = weights[grid.bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] * uniform
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]  # noqa: E731  every row has its end token
        n = len(first) - 1
        found = {"n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(add((word > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(np.log10(p)), pa.float64())}
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in names} | found)

    return X.named(X.absorb(chunks, counts, score, schema), names, fields, [f.name for f in more], [out + f.name for f in more])


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, fold("doc_id", 7) != 2)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), *[F.col(f"lm_{c}").alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
