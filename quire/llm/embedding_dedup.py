"""Embedding near-dedup: tiles of int8 products with rigorous error bounds.

Vectors with equal components are one class first, however many copies there are.
A unit vector x is stored as scale * q + e, q of small integers, with
|e| <= error known for each vector; then

    |x.y - scale_x scale_y q_x.q_y| <= error_x * |scale_y q_y| + error_y * |scale_x q_x| + error_x * error_y

Integer products of 64 to 1,000 components are exact in single precision, so a
tile of products is one matrix product.  Only pairs whose upper bound reaches the
threshold are computed again in double precision from the vectors themselves.

Tiles are made of vectors near the same of some pivots.  The angle between two
vectors is at least that between their pivots less their own angles to them;
tiles whose vectors are farther apart than the threshold allows are never paired.

Pairs of tiles are dealt in square blocks, so that a tile travels once for each
block of partners and not for each partner.

Vectors are scaled by powers of two before their lengths are taken, so that no
square overflows or vanishes; the cosine does not change by that.

Nulls: vectors that are null, zero, or hold null or non-finite components, and
vectors with another dimension than a partner's, link with nothing; a null id is
kept as it is, with no links.  Rows may repeat: rows with one id and equal vectors
are one vector, each of them returned with its result; rows with one id and
different vectors are vectors of their own, which link with others, and with each
other, as any do.  Other columns are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .components import components

THRESHOLD = 0.95
TILE = 2048
PIVOTS = 64
BLOCK_BYTES = 32_000_000  #: of vectors in double precision that a block holds


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings the largest component between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (integers up to 127, scale, length of the scaled integers, bound of the error's length)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1) * (1 + 1e-9) + 1e-12


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Places (i, j) of pairs with cosine >= threshold in double precision; of one tile with itself, i < j only."""
    ua, ub = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    qa, sa, la, ea = quantise(ua)
    qb, sb, lb, eb = (qa, sa, la, ea) if same else quantise(ub)
    whole = 127 * 127 * a.shape[1] < 1 << 24  # then single precision holds every sum
    kind = np.float32 if whole else np.float64
    fb = qb.astype(kind).T.copy()
    out = []
    for i in range(0, len(a), 512):
        near = qa[i : i + 512].astype(kind) @ fb
        bound = ((threshold - 1e-6 - ea[i : i + 512, None] * (lb + eb)[None, :] - eb[None, :] * la[i : i + 512, None]) / (sa[i : i + 512, None] * sb[None, :])).astype(kind)
        r, c = np.nonzero(near >= bound)
        r += i
        if same:
            r, c = r[r < c], c[r < c]
        for k in range(0, len(r), 1 << 18):
            rr, cc = r[k : k + (1 << 18)], c[k : k + (1 << 18)]
            exact = np.einsum("ij,ij->i", a[rr], b[cc]) / (np.linalg.norm(a[rr], axis=1) * np.linalg.norm(b[cc], axis=1))
            keep = exact >= threshold
            out.append(np.stack([rr[keep], cc[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of a tile's links, enough to connect what they connect."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = []
    for k, (i, j) in enumerate(pairs.tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return pairs[keep]


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable, itself included), kept (is it that one)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = X.checkpoint(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0)))))
    live = rows.where("good")
    # a checkpoint numbers classes once and for all
    classes = live.select("v", "id").distinct().groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = X.checkpoint(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("v")))
    n = classes.count()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    # pivots: a bounded sample of vectors, by hash; no more than tiles, as each makes a tile at least
    wanted = max(1, min(pivots, n // tile))
    dice = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = [r["v"] for r in classes.where((F.size("v") <= 1 << 14) & (dice < min(1.0, 8 * wanted / n))).orderBy("key").limit(wanted).collect()]
    by_size: dict[int, np.ndarray] = {}
    for s in {len(x) for x in sample}:
        p = scaled(np.array([x for x in sample if len(x) == s]))
        by_size[s] = p / np.linalg.norm(p, axis=1, keepdims=True)
    # tiles: of a pivot's vectors, as many groups as keep a tile below its size
    @F.pandas_udf("struct<pivot:int,angle:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        pivot, angle = np.full(len(v), -1), np.zeros(len(v))
        size = v.map(len).to_numpy()
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            if int(s) in by_size:
                x = scaled(np.stack(v.iloc[at].to_numpy()))
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ by_size[int(s)].T
                pivot[at] = cos.argmax(axis=1)
                angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
        return pd.DataFrame({"pivot": pivot, "angle": angle})

    placed = classes.withColumn("p", nearest("v")).select("node", "copies", "key", "v", F.size("v").alias("dim"), "p.pivot", "p.angle")
    placed = X.checkpoint(placed)
    shape = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"))  # a row per dimension and pivot
    groups = shape.withColumn("groups", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    tiled = placed.join(groups, ["dim", "pivot"]).withColumn("part", F.pmod("key", F.col("groups")).cast("int"))
    tiles = tiled.groupBy("dim", "pivot", "part").agg(F.min("angle").alias("near"), F.max("angle").alias("far"))
    # neighbouring tiles of a dimension make a side of a block
    side = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES / 16) / F.col("dim") / F.lit(tile)))
    first = groups.groupBy("dim").agg(F.sum("groups").alias("tiles"))
    tiles = tiles.join(first, "dim").withColumn("side", F.pmod(F.xxhash64("pivot", "part"), F.ceil(F.col("tiles") / side))).drop("tiles")
    tiles = X.checkpoint(tiles.withColumn("t", F.monotonically_increasing_id()))
    pairs = X.checkpoint(_partners(df.sparkSession, tiles, by_size, threshold))
    members = tiled.join(tiles.select("dim", "pivot", "part", "t"), ["dim", "pivot", "part"]).select("t", "node", "copies", "v")

    def pack(table: pa.Table) -> pa.Table:
        """A tile as one row, so that tiles and not vectors are dealt to the blocks; single precision where that is what the vectors hold."""
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        with np.errstate(over="ignore"):
            narrow = x.astype("<f4")
        whole = bool((narrow == x).all())
        head = np.array([table.num_rows, x.shape[1], whole], "<i8").tobytes()
        body = head + table.column("node").to_numpy().astype("<i8").tobytes() + table.column("copies").to_numpy().astype("<i8").tobytes() + (narrow if whole else x.astype("<f8")).tobytes()
        return pa.table({"t": pa.array([table.column("t")[0].as_py()], pa.int64()), "data": pa.array([X.pack(body)], pa.binary())})

    def unpack(data: bytes):
        raw = X.unpack(data)
        n, dim, whole = np.frombuffer(raw, "<i8", 3).tolist()
        nodes, copies = np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, "<i8", n, 24 + 8 * n)
        return nodes, copies, scaled(np.frombuffer(raw, "<f4" if whole else "<f8", n * dim, 24 + 16 * n).astype(np.float64).reshape(n, dim))

    packed = members.groupBy("t").applyInArrow(pack, "t long, data binary")
    block = ["dim", "s1", "s2"]
    needed = pairs.select(*block, "t").union(pairs.select(*block, F.col("t2").alias("t"))).distinct()
    dealt = needed.join(packed, "t").select(*block, "t", F.lit(None).cast("long").alias("t2"), "data")
    dealt = dealt.union(pairs.select(*block, "t", "t2", F.lit(None).cast("binary")))

    def compare(table: pa.Table) -> pa.Table:
        """n links of a (where a = b); of the links found enough to connect what they connect (n: 0)."""
        own = {t: unpack(d) for t, d in zip(table.column("t").to_pylist(), table.column("data").to_pylist()) if d is not None}
        out = [np.zeros((0, 3), np.int64)]
        links = {t: np.zeros(len(x[0]), np.int64) for t, x in own.items()}
        for t, t2 in zip(table.column("t").to_pylist(), table.column("t2").to_pylist()):
            if t2 is None:
                continue
            (na, ca, a), (nb, cb, b) = own[t], own[t2]
            found = linked_pairs(a, b, threshold, t == t2)
            i, j = found[:, 0], found[:, 1]
            links[t] += np.bincount(i, cb[j], len(na)).astype(np.int64)
            links[t2] += np.bincount(j, ca[i], len(nb)).astype(np.int64)
            shift = 0 if t == t2 else len(na)
            tree = _forest(np.stack([i, j + shift], axis=1), len(na) + len(nb))
            out.append(np.stack([na[tree[:, 0]], nb[tree[:, 1] - shift], np.zeros(len(tree), np.int64)], axis=1))
        for t, n in links.items():
            some = np.flatnonzero(n)
            out.append(np.stack([own[t][0][some], own[t][0][some], n[some]], axis=1))
        every = np.concatenate(out)
        return pa.table({c: pa.array(every[:, k], pa.int64()) for k, c in enumerate("abn")})

    found = X.checkpoint(dealt.groupBy(*block).applyInArrow(compare, "a long, b long, n long"))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    member = components(found.where("a <> b").select("a", "b"))
    known = classes.select("node", "v", "rep", "copies").join(links, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = X.checkpoint(known.groupBy("component").agg(F.min("rep").alias("least")))  # a row per component; the join may then split a large one
    known = known.join(least, "component").select("v", "copies", F.coalesce("n", F.lit(0)).alias("n"), "least")
    out = rows.join(known, "v", "left")
    out = out.select("id", F.when(F.col("good"), F.col("n") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _partners(spark: SparkSession, tiles: DataFrame, by_size: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """dim, s1, s2, t, t2: the pairs of tiles that have to be compared, and their blocks. Tiles are a thousandth of the vectors; each looks only at the tiles of pivots within reach."""
    limit = math.acos(threshold) + 1e-6  # an arc cosine near nought is wrong by 1e-8
    angles = [(int(d), i, j, float(math.acos(max(-1.0, min(1.0, float(p[i] @ p[j])))))) for d, p in by_size.items() for i in range(len(p)) for j in range(len(p))]
    between = spark.createDataFrame(angles, "dim int, pivot int, other int, between double")  # pivots squared: bounded
    near = tiles.where("pivot >= 0").join(F.broadcast(between), ["dim", "pivot"])
    alone = tiles.where("pivot < 0").select("*", F.lit(-1).alias("other"), F.lit(0.0).alias("between"))  # of dimensions without pivots
    x = near.select(*alone.columns).unionByName(alone)
    y = tiles.select("dim", F.col("pivot").alias("other"), F.col("t").alias("t2"), F.col("near").alias("near2"), F.col("far").alias("far2"), F.col("side").alias("side2"))
    both = x.join(y, ["dim", "other"]).where("t <= t2")
    # for some vectors of the two tiles, |angle - between - ...| can be within the limit
    apart = F.greatest(F.col("between") - F.col("far") - F.col("far2"), F.col("near") - F.col("far2") - F.col("between"), F.col("near2") - F.col("far") - F.col("between"), F.lit(0.0))
    both = both.where((apart <= limit) | (F.col("pivot") < 0))
    return both.select("dim", F.least("side", "side2").alias("s1"), F.greatest("side", "side2").alias("s2"), "t", "t2")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup(X.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")
