"""Byte-level BPE encoding and decoding as a reduction over a tree.

A text is halved until the pieces are short, each piece is encoded, and
neighbours are joined upwards.  A join re-encodes only a window around the cut:

* between words: no match of the pattern holds a non-space character followed by
  a space character, so a place where one follows the other is a boundary of
  matches in every text around it.  The window grows until it ends at such places
  on both sides (or at the ends of the text); tokens outside it are final.
* inside one long match: two neighbouring tokens are *compatible* if the bytes of
  both encode to just those two.  A sequence of tokens is the encoding of its
  bytes exactly if all its neighbours are compatible.  The window grows until its
  outermost tokens are compatible with their neighbours outside.

Decoding halves the ids and concatenates up the tree.

Nulls: a null text is empty and has no ids.  Special tokens' strings are ordinary
text.  A column of the input that has an output's name gives way to it.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X

LEAF = 256  #: characters of a text that are encoded by themselves
PIECE = 64  #: bytes of a match that are merged by themselves
KNOWN = 1 << 18  #: short matches whose tokens a worker remembers
PAIRS = 1 << 16  #: pairs of tokens of which a worker remembers whether they are compatible
#: Unicode's White_Space, as a class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SAFE = regex.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
LAST = regex.compile(f"(?r)(?<=[^{WHITE}])(?=[{WHITE}])")


def default_vocabulary() -> tuple[str, str]:
    """The path of the ranks and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        found = regex.compile(pattern)
        self.matches = (lambda t: [m.group() for m in found.finditer(t)]) if found.groups else found.findall
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- text

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= LEAF:
            return self._window(text[a:b])
        cut = (a + b) // 2
        return self._join(text, a, cut, b, self._encode(text, a, cut), self._encode(text, cut, b))

    def _join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = self._before(text, a, cut), self._after(text, cut, b)
        middle = self._window(text[lo:hi])
        return left[: len(left) - self._count(left, len(text[lo:cut].encode()), -1)] + middle + right[self._count(right, len(text[cut:hi].encode()), 1) :]

    def _before(self, text: str, a: int, cut: int) -> int:
        """The last boundary before the cut; at the cut itself the next character isn't known."""
        found = LAST.search(text, a, cut)
        return a if found is None else found.start()

    def _after(self, text: str, cut: int, b: int) -> int:
        found = SAFE.search(text, cut, b)
        return b if found is None else max(found.start(), cut)

    def _count(self, tokens: list[int], n_bytes: int, step: int) -> int:
        """How many tokens from one end hold so many bytes; boundaries of matches are boundaries of tokens."""
        n = i = 0
        while n < n_bytes:
            n += len(self.bytes_of[tokens[i if step > 0 else -1 - i]])
            i += 1
        if n != n_bytes:
            raise AssertionError("a window ends inside a token")
        return i

    def _window(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for match in self.matches(text):
            tokens = known.get(match)
            if tokens is None:
                tokens = self.piece(match.encode())
                if len(match) <= 32:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[match] = tokens
            out += tokens
        return out

    # -- one match

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._halves(data, 0, len(data))

    def _halves(self, data: bytes, a: int, b: int) -> list[int]:
        if b - a <= PIECE:
            return self.merge(data[a:b])
        cut = (a + b) // 2
        return self.join(self._halves(data, a, cut), self._halves(data, cut, b))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i, j = min(1, len(left)), min(1, len(right))
        while True:
            middle = self.merge(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            more_left = i < len(left) and middle and not self.compatible(left[-1 - i], middle[0])
            more_right = j < len(right) and middle and not self.compatible(middle[-1], right[j])
            if not (more_left or more_right):
                return left[: len(left) - i] + middle + right[j:]
            i, j = min(len(left), 2 * i) if more_left else i, min(len(right), 2 * j) if more_right else j

    def compatible(self, a: int, b: int) -> bool:
        """Do two tokens stay as they are beside each other?"""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def merge(self, data: bytes) -> list[int]:
        """Pairs by least rank, leftmost first, until none merges. The pieces are short, so all pairs are looked at again each time."""
        ranks = self.ranks
        if not data:
            return []
        cut = list(range(len(data) + 1))
        none = len(self.bytes_of)
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]  # pairs[i]: of the parts that begin at cut[i] and cut[i + 1]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            del cut[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(data[cut[i] : cut[i + 2]], none)
            if i:
                pairs[i - 1] = ranks.get(data[cut[i - 1] : cut[i + 1]], none)
        return [ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    # -- back

    def decode(self, ids) -> bytes:
        n = len(ids)
        if n <= 4096:
            return b"".join([self.bytes_of[i] for i in ids])
        return self.decode(ids[: n // 2]) + self.decode(ids[n // 2 :])


class Vocabulary:
    """What goes to the workers. A worker makes the encoder when it first needs it; what it remembers goes with the broadcast, when Spark gives the worker to another query."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks_file, self.pattern = ranks_file, pattern

    @functools.cached_property
    def tree(self) -> TreeEncoder:
        return encoder(self.ranks_file, self.pattern)


def encoder(ranks_file: bytes, pattern: str) -> TreeEncoder:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return TreeEncoder(ranks, pattern)


def bpe_encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decode: bool = False, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """All columns, and ``ids_col``: the ids as little-endian unsigned 32-bit integers (binary).

    With ``decode``, also ``decoded_col`` (binary): what the ids decode to.  The vocabulary, under a megabyte, goes to the workers
    with the function; its path is only read by the driver."""
    path, own = (None, None) if ranks_path and pattern else default_vocabulary()
    with open(ranks_path or path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(Vocabulary(f.read(), pattern or own))
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at = [f.name for f in fields].index(text_col)
    inner = df.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, inner.schema.fields)] + [T.StructField("ids", T.BinaryType())] + [T.StructField("back", T.BinaryType())] * decode)

    def run(batches):
        tree = shared.value.tree
        for whole in batches:
            for batch in X.slices(whole, names[at], 4 * X.CHUNK_BYTES):
                ids, back = [], []
                for text in batch.column(names[at]):
                    found = np.array(tree.encode(text.as_py() or ""), "<u4")
                    ids.append(found.tobytes())
                    if decode:
                        back.append(tree.decode(found.tolist()))
                out = {n: batch.column(n) for n in names} | {"ids": pa.array(ids, pa.binary())} | ({"back": pa.array(back, pa.binary())} if decode else {})
                yield pa.RecordBatch.from_pydict(out)

    return X.named(X.arrow(inner).mapInArrow(run, schema), names, fields, ["ids"] + ["back"] * decode, [ids_col] + [decoded_col] * decode)


def bpe_decode(df: DataFrame, ids_col: str = "token_ids", ranks_path: str | None = None, pattern: str | None = None, decoded_col: str = "decoded") -> DataFrame:
    """All columns, and ``decoded_col`` (binary): the bytes of the packed ids; null ids decode to nothing."""
    path, own = (None, None) if ranks_path and pattern else default_vocabulary()
    with open(ranks_path or path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(Vocabulary(f.read(), pattern or own))

    @F.pandas_udf("binary")
    def back(ids):
        tree = shared.value.tree
        return ids.map(lambda x: tree.decode(np.frombuffer(x or b"", "<u4").tolist()))

    return df.withColumn(decoded_col, back(F.col(ids_col)))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_encode(X.read(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)
    return found.select("doc_id", F.expr("length(token_ids) div 4").cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
