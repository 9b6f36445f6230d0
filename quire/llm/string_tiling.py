"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items that start a shared run of ``least`` words
are seeds; documents without a seed are done.  For the others, the longest matches
of unmarked words between item and document are marked again and again (running
Karp-Rabin with falling search lengths), so that an item whose passages were
reordered is still covered.  A document is contaminated if its tiles cover
``coverage`` of an item's words.

The benchmark is dealt to the workers in blocks of bounded size, one pass a block,
so it may be larger than a worker's memory.  With several blocks, a filter of fixed
size over all seeds first sets aside the documents that hold none of them.

Nulls: a null text has no words and matches nothing; an item with fewer than
``least`` words can't be matched; ties go to the smallest item id; an item with a
null id counts as -1.  Rows may repeat; each is judged by itself.  A column of the
input that has an output's name gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import repeats as R

U = np.uint64
LEAST = 5
COVERAGE = 0.5
BLOCK_BYTES = 8_000_000
FILTER_BITS = 27  #: the filter over all seeds has 2 ** 27 of them, 16 MB
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of letters, digits and characters beyond ASCII.
_APART = np.array([not (c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122) for c in range(256)])
_P = 0x5851F42D4C957F2D


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = X.text_buffer(column)
    raw = _LOWER[raw]
    starts, ends, first = R.words_of(raw, at, _APART)
    return R.word_hashes(raw, starts, ends), first


def grams(t: np.ndarray, n: int) -> np.ndarray:
    if len(t) < n:
        return np.zeros(0, U)
    m = len(t) - n + 1
    h = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ t[i : i + m]) * U(_P)
            h ^= h >> U(31)
    return R.mix(h)


def running_matches(item: list[int], doc: list[int], marked_item: bytearray, marked_doc: bytearray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words, as (words, place in item, place in document), by rolling hashes of ``length`` words."""
    mod = (1 << 61) - 1
    base = 1_000_003
    power = pow(base, length - 1, mod)

    def rolling(t, marked):
        h = run = 0
        for i, x in enumerate(t):
            if marked[i]:
                h = run = 0
                continue
            if run >= length:
                h = (h - t[i - length] % mod * power) % mod
            h = (h * base + x) % mod
            run += 1
            if run >= length:
                yield i - length + 1, h

    table: dict[int, list[int]] = {}
    for at, h in rolling(item, marked_item):
        table.setdefault(h, []).append(at)
    found = []
    for d, h in rolling(doc, marked_doc):
        for i in table.get(h, ()):
            k = 0
            while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not marked_item[i + k] and not marked_doc[d + k]:
                k += 1
            if k >= length:
                found.append((k, i, d))
    return found


def greedy_tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (words, place in item, place in document): longest first, none overlapping another in either."""
    marked_item, marked_doc = bytearray(len(item)), bytearray(len(doc))
    tiles = []
    length = max(least, min(len(item), len(doc)))
    while True:
        matches = running_matches(item, doc, marked_item, marked_doc, length)
        while matches:
            # longest first; of equals the earliest in the document, then in the item
            matches.sort(key=lambda x: (-x[0], x[2], x[1]))
            again = False
            for k, i, d in matches:
                if not any(marked_item[i : i + k]) and not any(marked_doc[d : d + k]):
                    marked_item[i : i + k] = b"\1" * k
                    marked_doc[d : d + k] = b"\1" * k
                    tiles.append((k, i, d))
                else:
                    again = True
            matches = running_matches(item, doc, marked_item, marked_doc, length) if again else []
        if length == least:
            return tiles
        length = max(least, length // 2)


@dataclass
class Block:
    """A bounded part of the benchmark: items' words, and the items of each seed."""

    ids: list[int]
    items: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], least: int) -> Block:
        rows = sorted(((-1 if i is None else i), t or "") for i, t in rows)
        t, first = text_words(pa.array([r[1] for r in rows], pa.string()))
        items = [t[a:b] for a, b in zip(first[:-1], first[1:])]
        hashes = [grams(x, least) for x in items]
        every = np.concatenate([*hashes, np.zeros(0, U)])
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        seeds, at = np.unique(every[order], return_index=True)
        sieve = np.zeros(1 << 18, bool)
        sieve[(seeds & U((1 << 18) - 1)).astype(np.int64)] = True
        return cls([r[0] for r in rows], items, seeds, np.append(at, len(order)), owner[order], place[order], sieve)

    def matches(self, t: np.ndarray, first: np.ndarray, least: int, coverage: float):
        """(row, item id, coverage, tiles) of every item that a row covers enough of."""
        if not len(self.seeds) or len(t) < least:
            return
        g = grams(t, least)
        at = np.flatnonzero(self.sieve[(g & U((1 << 18) - 1)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.seeds, g[at]), len(self.seeds) - 1)
        hit = self.seeds[where] == g[at]
        at, where = at[hit], where[hit]
        row = np.searchsorted(first, at, "right") - 1
        whole = at + least <= first[row + 1]
        at, where, row = at[whole], where[whole], row[whole]
        cut = np.searchsorted(row, np.arange(len(first)))
        for r in np.unique(row).tolist():
            a, b = cut[r], cut[r + 1]
            number = self.first[where[a:b] + 1] - self.first[where[a:b]]
            of = np.repeat(np.arange(a, b), number)
            entry = np.repeat(self.first[where[a:b]], number) + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            owners = self.owner[entry]
            order = np.argsort(owners, kind="stable")
            begins = np.flatnonzero(np.diff(owners[order], prepend=-1))
            for p, q in zip(begins, np.append(begins[1:], len(order))):
                part = order[p:q]
                k = int(owners[part[0]])
                item = self.items[k]
                reach = np.zeros(len(item), bool)
                for s in range(least):
                    reach[self.place[entry[part]] + s] = True
                if reach.sum() < coverage * len(item):
                    continue  # tiles can't cover what no seed covers
                # words of the row that are in no shared seed are in no tile: one sign that matches nothing stands for each gap
                near = np.unique((at[of[part]][:, None] + np.arange(least)).ravel())
                gap = np.flatnonzero(np.diff(near) > 1)
                words = np.insert(t[near].astype(object), gap + 1, -1).tolist()
                tiles = greedy_tiles(item.tolist(), words, least)
                covered = sum(x[0] for x in tiles) / len(item)
                if covered >= coverage:
                    yield r, self.ids[k], covered, len(tiles)


def _flag(packed, text: str, least: int):
    """Adds ``maybe``: does a row hold a run of words whose hash any seed has?"""

    def run(batches):
        sieve = np.unpackbits(packed.value).view(bool)
        for whole in batches:
            for part in X.slices(whole, text):
                t, first = text_words(part.column(text))
                maybe = np.zeros(part.num_rows, bool)
                if len(t) >= least:
                    at = np.flatnonzero(sieve[(grams(t, least) & U(len(sieve) - 1)).astype(np.int64)])
                    row = np.searchsorted(first, at, "right") - 1
                    maybe[row[at + least <= first[row + 1]]] = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(maybe)], names=[*part.schema.names, "maybe"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE, out: str = "leak_") -> DataFrame:
    """All columns, and ``out`` + contaminated (boolean), coverage (of the item covered best; 0 if none is covered enough), item_id, tiles, items (all items covered enough)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    text = names[[f.name for f in fields].index(text_col)]
    found_type = "array<struct<coverage:double,item:long,tiles:int>>"
    df = docs.toDF(*names).withColumn(text, F.col(text).cast("string")).withColumn("found", F.array().cast(found_type))
    kind = pa.list_(pa.struct([("coverage", pa.float64()), ("item", pa.int64()), ("tiles", pa.int32())]))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    part_of = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    rows_of = lambda b: [(r["i"], r["t"]) for r in items.where(part_of == b).collect()]  # noqa: E731  about BLOCK_BYTES
    clean = None
    if blocks > 1:
        sieve = np.zeros(1 << FILTER_BITS, bool)
        for b in range(blocks):
            sieve[(Block.of(rows_of(b), least).seeds & U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        packed = docs.sparkSession.sparkContext.broadcast(np.packbits(sieve))
        flagged = X.arrow(df).mapInArrow(_flag(packed, text, least), T.StructType([*schema.fields, T.StructField("maybe", T.BooleanType())]))
        clean = flagged.where("not maybe").drop("maybe")
        df = X.checkpoint(flagged.where("maybe").drop("maybe"))
    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Block.of(rows_of(b), least))

        def run(batches, shared=shared):
            for whole in batches:
                for part in X.slices(whole, text):
                    t, first = text_words(part.column(text))
                    found = part.column("found").to_pylist()
                    for r, item, covered, tiles in shared.value.matches(t, first, least, coverage):
                        found[r] = (found[r] or []) + [{"coverage": covered, "item": item, "tiles": tiles}]
                    yield pa.RecordBatch.from_pydict({n: part.column(n) for n in names} | {"found": pa.array(found, kind)})

        df = X.arrow(df).mapInArrow(run, schema)
        if blocks > 1:  # one block in a worker at a time
            df = X.checkpoint(df)
    if clean is not None:
        df = df.unionByName(clean)
    best = F.array_sort("found", lambda x, y: F.when(x["coverage"] != y["coverage"], F.when(x["coverage"] > y["coverage"], -1).otherwise(1)).when(x["item"] < y["item"], -1).when(x["item"] > y["item"], 1).otherwise(0))[0]
    some = F.size("found") > 0
    best = F.when(some, best)
    more = {"contaminated": some, "coverage": F.coalesce(best["coverage"], F.lit(0.0)), "item_id": best["item"], "tiles": F.coalesce(best["tiles"], F.lit(0)).cast("long"), "items": F.array_sort(F.transform("found", lambda x: x["item"]))}
    found = df.select(*names, *[c.alias(m) for m, c in more.items()])
    return X.named(found, names, fields, list(more), [out + m for m in more])


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(X.read(spark, sf_dir, "documents").select("doc_id", "text"), X.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("leak_contaminated").alias("contaminated"), F.col("leak_coverage").alias("coverage"), F.col("leak_item_id").alias("item_id"), F.col("leak_tiles").alias("tiles"), F.concat_ws(",", F.transform("leak_items", lambda x: x.cast("string"))).alias("items"))
