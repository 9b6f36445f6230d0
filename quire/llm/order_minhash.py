"""Near-dedup by Order MinHash.

A text's k-mers are its runs of three words, each labelled with how often it has
occurred before, so that no two are equal.  A sketch is made of the two k-mers
with the least hashes, one of them among first occurrences (else texts that repeat
one phrase would all meet), *in the order of the text*; two texts have equal
sketches with a probability that grows with their edit similarity.  Texts with an
equal sketch in one of several bands are candidates (of texts whose similarity is
the least that counts, 0.8, by words changed here and there, 98 in 100 are); a
banded alignment of their words verifies them: similarity is 1 - edits / words of
the longer text, and nothing else is asked for.

Equal texts are one class before anything is compared.  The members of a band's
group are compared with a hub of it, in salted parts, so a group of copies is
linear in its members.  A passage that very many texts share brings unlike texts
together: where links don't connect all members of a group, all of them are
compared with each other, in pairs of tiles, and aligned unless they are connected
already or their counts of words show that they can't be copies.  So all copies
that share a sketch end in one class; such a group takes time that grows with the
square of its members.

Nulls and ties: words are lower-cased (A-Z) runs of characters other than space
and tab to carriage return.  Rows without words, or without an id, are never
linked and always kept.  The member with the smallest id stands for its class;
rows that repeat an id and text are returned each.  Other columns are not.  Words
are told apart by 64-bit hashes where texts are sketched, by 32 bits of them where
two texts are aligned.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import repeats as R
from .components import components

U = np.uint64
WORDS = 3
SAMPLED = 2
BANDS = 32
RUN = 5  #: words of the runs that an alignment goes through
SIMILARITY = 0.8
PART = 256
SPAN = 128  #: rows of a diagonal that an alignment holds at once
TILE = 1024  #: texts of a tile
TILE_WORDS = 1 << 20
_A = R.mix(np.arange(1, 2 * BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_words(column: pa.Array):
    """(lower-cased bytes, word hashes, first word of each row, start and end of each word)"""
    raw, at = X.text_buffer(column)
    raw = _LOWER[raw]
    starts, ends, first = R.words_of(raw, at)
    return raw, R.word_hashes(raw, starts, ends), first, starts, ends


def sketches(t: np.ndarray, first: np.ndarray, words: int = WORDS, sampled: int = SAMPLED, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) of sketch hashes; rows without words get zeros."""
    n_rows = len(first) - 1
    size = np.diff(first)
    out = np.zeros((n_rows, bands), U)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    kmers = np.maximum(size[some] - words + 1, 1)  # a shorter text is one k-mer
    at = np.cumsum(np.append(0, kmers))
    row = np.repeat(np.arange(len(some)), kmers)
    begin = first[some][row] + np.arange(at[-1]) - at[row]
    length = np.minimum(words, size[some])[row]
    g = np.zeros(len(begin), U)
    with np.errstate(over="ignore"):
        for w in range(words):
            use = np.minimum(begin + w, len(t) - 1)
            g = np.where(w < length, (g ^ t[use]) * U(0xC2B2AE3D27D4EB4F) + U(w), g)
            g ^= g >> U(29)
        key = R.mix(g + row.astype(U) * U(0x165667B19E3779F9))
        order = np.argsort(key, kind="stable")  # occurrences in text order
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        label = np.empty(len(key), U)
        label[order] = rank.astype(U)
        h = R.mix(g + label * U(0xD6E8FEB86659FD93))
        top = U(2**64 - 1)
        for band in range(bands):
            v = (h ^ _A[2 * band]) * _A[2 * band + 1]
            v ^= v >> U(32)
            where = np.full((len(some), sampled), -1, np.int64)
            for s in range(sampled):
                if s == 0:  # the first one among first occurrences
                    least = np.minimum.reduceat(np.where(label == 0, v, top), at[:-1])
                else:
                    least = np.minimum.reduceat(v, at[:-1])
                hit = np.flatnonzero(v == np.repeat(least, kmers))
                own, one = np.unique(row[hit], return_index=True)
                pick = hit[one]
                left = s < kmers[own]
                where[own[left], s] = pick[left]
                v[pick] = top
            where = np.sort(where, axis=1)  # the order of the text
            sketch = np.full(len(some), U(band + 1))
            for s in range(sampled):
                sketch = R.mix(sketch * U(0x9E3779B97F4A7C15) + np.where(where[:, s] >= 0, h[where[:, s]], U(7)))
            out[some, band] = sketch
    return out


def shingles(t: np.ndarray, words: int = RUN) -> np.ndarray:
    """Hashes of all runs of so many words of one text; a shorter one is a run itself."""
    n = max(1, len(t) - words + 1)
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for w in range(min(words, len(t))):
            h = (h ^ t[w : w + n]) * U(0xC2B2AE3D27D4EB4F) + U(w)
            h ^= h >> U(29)
    return h


def chained(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> int:
    """Edits of one alignment, so no fewer than needed: it goes through k-mers that each text has once, as many as stand in one order."""
    ua, ia, na = np.unique(ha, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(hb, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    pa, pb = ia[na == 1][x], ib[nb == 1][y]
    if not len(pa):
        return max(len(a), len(b))
    order = np.argsort(pa)
    pa, pb = pa[order], pb[order]
    if (np.diff(pb) <= 0).any():
        tails: list[int] = []
        at: list[int] = []
        back = np.full(len(pb), -1)
        for i, p in enumerate(pb.tolist()):
            k = bisect_left(tails, p)
            if k == len(tails):
                tails.append(p)
                at.append(i)
            else:
                tails[k], at[k] = p, i
            back[i] = at[k - 1] if k else -1
        chain = []
        i = at[-1]
        while i >= 0:
            chain.append(i)
            i = back[i]
        pa, pb = pa[chain[::-1]], pb[chain[::-1]]
    size = min(RUN, len(a), len(b))
    new = np.flatnonzero(np.append(True, (np.diff(pa) != np.diff(pb)) | (np.diff(pa) > size)))
    end = np.append(new[1:], len(pa)) - 1
    sa, sb, ea, eb = pa[new], pb[new], pa[end] + size, pb[end] + size
    edits = _gap(a[: sa[0]][::-1], b[: sb[0]][::-1]) + _gap(a[ea[-1] :], b[eb[-1] :])
    for i in range(len(new) - 1):
        if (m := min(sa[i + 1] - ea[i], sb[i + 1] - eb[i])) < 0:
            edits += abs(int((sa[i + 1] - ea[i]) - (sb[i + 1] - eb[i])))
        elif m == 0:
            edits += int(max(sa[i + 1] - ea[i], sb[i + 1] - eb[i]))
        else:
            edits += _gap(a[ea[i] : sa[i + 1]], b[eb[i] : sb[i + 1]])
    return edits


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return max(len(a), len(b)) - int((a[:n] == b[:n]).sum())


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Do two texts (word hashes) count as copies?"""
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < similarity * longest - 1e-9:
        return False
    if 1 - chained(a, b, shingles(a), shingles(b)) / longest >= similarity:
        return True
    # an edit changes three runs of three words at most, so copies share the others
    least = longest - 2 - 3 * int((1 - similarity) * longest + 1e-9)
    if least > 0:
        (ka, na), (kb, nb) = (np.unique(shingles(t, 3), return_counts=True) for t in (a, b))
        _, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        if int(np.minimum(na[x], nb[y]).sum()) < least:
            return False
    return aligned(a, b, similarity) is not None


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float | None:
    """1 - edits / words of the longer, if that is ``similarity`` at least: by furthest-reaching points on the diagonals of a band."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return 1 - d / longest if d <= most else None
    _, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    kinds = int(of.max()) + 1
    shared = int(np.minimum(np.bincount(of[: len(a)], minlength=kinds), np.bincount(of[len(a) :], minlength=kinds)).sum())
    if max(len(a), len(b)) - shared > most:
        return None
    n, m = len(a), len(b)
    stops: dict[int, tuple[int, int, list[int]]] = {}  # of each diagonal, some rows from .. to and those of them that differ

    def slide(i: int, k: int) -> int:
        """From row i on diagonal k (column i + k), the first row that differs."""
        hi = min(n, m - k)
        while i < hi:
            begin, end, s = stops.get(k, (0, 0, []))
            if not begin <= i < end:
                begin, end = i, min(hi, i + SPAN)
                s = (np.flatnonzero(a[begin:end] != b[begin + k : end + k]) + begin).tolist()
                stops[k] = begin, end, s
            at = bisect_left(s, i)
            if at < len(s):
                return s[at]
            i = end
        return i

    goal = m - n
    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 1.0
    for d in range(1, most + 1):
        new = {}
        low, high = max(-d, -n, goal - (most - d)), min(d, m, goal + (most - d))
        for k in range(low, high + 1):
            i = -1
            if (x := reach.get(k)) is not None:
                i = x + 1
            if (x := reach.get(k - 1)) is not None and x > i:
                i = x
            if (x := reach.get(k + 1)) is not None and x + 1 > i:
                i = x + 1
            if i < 0:
                continue
            i = min(i, n, m - k)
            if i < max(0, -k):
                continue
            new[k] = slide(i, k)
        reach = new
        if reach.get(goal, -1) >= n:
            return 1 - d / longest
    return None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row: id, class_id (the smallest id that links lead to, itself included), n_links (other rows linked directly: equal texts, and those that were aligned with), kept (is it that one)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches):
        for whole in batches:
            for b in X.slices(whole, "text"):
                raw, t, first, starts, ends = text_words(b.column("text"))
                found = sketches(t, first)
                size = np.diff(first)
                cut = first.tolist()
                data = raw.tobytes()
                keys = []
                for i in range(b.num_rows):
                    if size[i]:
                        words = data[int(starts[cut[i]]) : int(ends[cut[i + 1] - 1])].split()
                        keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    else:
                        keys.append(None)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS), pa.int32()), pa.array(found.view(np.int64).ravel()))
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "key": pa.array(keys, pa.binary()), "size": pa.array(size, pa.int64()), "bands": flat})

    made = X.checkpoint(X.arrow(rows).mapInArrow(sketch, "id long, key binary, size long, bands array<long>"))
    live = made.where("key is not null and id is not null")
    classes = X.checkpoint(live.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))  # a checkpoint numbers classes once and for all
    links, member = _links(rows, classes, similarity)
    degree = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = degree.join(classes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    known = classes.join(degree, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = X.checkpoint(known.groupBy("component").agg(F.min("rep").alias("class_id")))  # a row per class; the join may then split a large one
    known = known.join(least, "component").select("key", "class_id", "rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = made.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    out = out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))


def _hubs(members: DataFrame) -> DataFrame:
    """members: g, at, node, size. Groups of several, each row with the group's hub (the least node) and the hub's size."""
    tied = members.groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("h")).where("n > 1").select("g", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"))
    return members.join(tied, "g")


def _links(rows: DataFrame, classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """a, b: verified links between class nodes, enough to connect all that share a sketch and are copies; and node, component of those that have a link."""
    band = classes.select("node", "size", F.posexplode("bands").alias("at", "sketch"))
    groups = X.checkpoint(_hubs(band.select(F.xxhash64("at", "sketch").alias("g"), "node", "size")))
    wanted = classes.join(groups.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("id"), "node", "key")
    texts = X.checkpoint(_words(rows.join(wanted, "id")))
    edges = groups.where("node <> hub").select(F.col("hub").alias("a"), F.col("hub_size").alias("na"), F.col("node").alias("b"), F.col("size").alias("nb")).distinct()
    found = X.checkpoint(_verify(texts, edges, similarity))
    # all members were compared with the hub; the others of a group have to be compared unless links connect them already
    member = components(found)
    label = member.withColumnRenamed("component", "label")
    others = groups.where("node <> hub").select("g", "node", "size").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = others.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g")
    others = X.checkpoint(others.join(mixed, "g", "left_semi"))
    if not others.isEmpty():
        more = _compare_all(texts, others, similarity)
        if not more.isEmpty():
            # components that the new links join, as one node each; links of nodes that had none count as such
            found = found.union(more)
            of = lambda c: more.join(label.withColumnRenamed("node", c), c, "left").select("a", "b", F.coalesce("label", c).alias(f"l{c}"))
            joined = of("a").join(of("b").select("a", "b", "lb"), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
            larger = components(joined).withColumnRenamed("node", "label").withColumnRenamed("component", "wider")
            ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
            every = ends.join(label, "node", "full").withColumn("label", F.coalesce("label", "node"))
            member = X.checkpoint(every.join(larger, "label", "left").select("node", F.coalesce("wider", "label").alias("component")))
    return X.checkpoint(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), member


def _compare_all(texts: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """members: g, node, size, label (equal for what is connected). a, b: links that connect all copies within a group.

    A group is cut into tiles of texts of about one length, and tiles into pairs unless their lengths are too far apart."""
    ratio = -math.log(min(max(similarity, 1e-6), 1 - 1e-6))
    members = members.withColumn("s", F.floor(F.log("size") / F.lit(ratio) + F.lit(1e-6)))
    parts = members.groupBy("g", "s").agg(F.ceil(F.greatest(F.count("*") / F.lit(TILE), F.sum("size") / F.lit(TILE_WORDS))).alias("parts"))
    members = members.join(parts, ["g", "s"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    tiles = X.checkpoint(members.groupBy("g", "s", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("label").alias("lo"), F.max("label").alias("hi")))
    x = tiles.withColumn("s2", F.explode(F.array(F.col("s"), F.col("s") + 1)))
    y = tiles.select("g", F.col("s").alias("s2"), F.col("part").alias("part2"), F.col("n").alias("n2"), F.col("words").alias("words2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = x.join(y, ["g", "s2"]).where("s < s2 or part <= part2").where("least(lo, lo2) <> greatest(hi, hi2)")
    both = X.checkpoint(both.withColumn("pair", F.xxhash64("g", "s", "part", "s2", "part2")).withColumn("one", (F.col("s") == F.col("s2")) & (F.col("part") == F.col("part2"))))
    held = both.agg(F.sum(F.col("n") + F.col("n2")), F.sum(F.col("words") + F.col("words2"))).first()
    if not held[0]:
        return texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    buckets = max(1, math.ceil(held[0] / (4 * TILE)), math.ceil(held[1] / (2 * TILE_WORDS)))
    sides = both.select("pair", "g", "s", "part", F.lit(True).alias("first")).union(both.where("not one").select("pair", "g", F.col("s2").alias("s"), F.col("part2").alias("part"), F.lit(False).alias("first")))
    dealt = sides.join(members.select("g", "s", "part", "node", "label"), ["g", "s", "part"]).join(texts, "node")
    dealt = dealt.select(F.pmod("pair", F.lit(buckets)).alias("bucket"), "pair", "first", "node", "label", "words")

    def run(table: pa.Table) -> pa.Table:
        pair, first, node, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "first", "node", "label"))
        words = [np.frombuffer(w.as_py(), "<u4").astype(U) for w in table.column("words")]
        order = np.lexsort([~first, pair])
        cut = np.append(np.flatnonzero(np.append(True, np.diff(pair[order]) != 0)), len(order))
        out = [np.zeros((0, 2), np.int64)]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = order[i:j]
            made = connect([words[k] for k in own], label[own], int(first[own].sum()), similarity)
            out.append(node[own][made])
        made = np.concatenate(out)
        return pa.table({"a": pa.array(made[:, 0], pa.int64()), "b": pa.array(made[:, 1], pa.int64())})

    return X.checkpoint(dealt.groupBy("bucket").applyInArrow(run, "a long, b long").distinct())


def connect(texts: list[np.ndarray], label: np.ndarray, first: int, similarity: float) -> np.ndarray:
    """Places (i, j) of copies among ``texts`` that connect what is not connected by ``label``: of the first so many with the others, or, if there are no others, with each other.

    An edit takes one word and brings one, at most, so texts whose counts of words (by 8 bits of their hashes) differ more than edits may are not aligned."""
    size = np.array([len(t) for t in texts])
    counts = np.stack([np.bincount((t & U(255)).astype(np.int64), minlength=256) for t in texts]).astype(np.int32)
    label = label.copy()
    out = []
    for i in range(first):
        begin = i + 1 if first == len(texts) else first
        longest = np.maximum(size[begin:], size[i])
        may = (label[begin:] != label[i]) & (np.minimum(size[begin:], size[i]) >= similarity * longest - 1e-9)
        near = np.flatnonzero(may)
        if not len(near):
            continue
        more = np.maximum(counts[begin + near] - counts[i], 0).sum(axis=1)
        edits = np.maximum(more, more - size[begin + near] + size[i])
        for j in (begin + near[edits <= (1 - similarity) * longest[near] + 1e-9]).tolist():
            if label[j] != label[i] and alike(texts[i], texts[j], similarity):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _words(wanted: DataFrame) -> DataFrame:
    """node, words: 32-bit word hashes of the rows whose text is the class's (an id may repeat with another text)."""

    def run(batches):
        for whole in batches:
            for b in X.slices(whole, "text"):
                raw, t, first, starts, ends = text_words(b.column("text"))
                data, cut = raw.tobytes(), first.tolist()
                keep, words = [], []
                for i, key in enumerate(b.column("key").to_pylist()):
                    if cut[i + 1] > cut[i]:
                        own = data[int(starts[cut[i]]) : int(ends[cut[i + 1] - 1])].split()
                        if hashlib.blake2b(b" ".join(own), digest_size=16).digest() == key:
                            keep.append(i)
                            words.append((t[cut[i] : cut[i + 1]] >> U(32)).astype("<u4").tobytes())
                part = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "words": pa.array(words, pa.binary())})

    return X.arrow(wanted).mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


def _verify(texts: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """a, b: those edges (a, na, b, nb: nodes and their words) whose texts are copies. The partners of a are dealt in parts, each with its own copy of a's words."""
    near = edges.where(F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")).select("a", "b")
    number = near.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    dealt = near.join(number, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = dealt.join(texts.select(F.col("node").alias("b"), "words"), "b").select("a", "part", "b", "words")
    heads = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), "words"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "words")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["b"].isna().to_numpy()
        own = np.frombuffer(pdf["words"][head].iloc[0], "<u4").astype(U)
        rest = pdf[~head]
        ok = [alike(own, np.frombuffer(w, "<u4").astype(U), similarity) for w in rest["words"]]
        return pd.DataFrame({"a": rest["a"].astype("int64"), "b": rest["id"].astype("int64")})[ok]

    both = members.withColumn("id", F.col("b")).unionByName(heads.withColumn("id", F.lit(0).cast("long")))
    return both.groupBy("a", "part").applyInPandas(compare, "a long, b long")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(X.read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
