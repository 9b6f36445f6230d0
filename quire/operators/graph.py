"""The concept graph: counts, components, cycles.

A graph whose edges are counted and found to be few (SMALL) is walked within one
task, by Tarjan's algorithm.  Beyond that, iterated joins: loops cut their lineage
through the shared checkpoint folder, so a lost worker costs a recomputation and
never a result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (distinct) up to which one task walks the graph: some tens of MB.
SMALL = 200_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Through spark.checkpoint.dir; a folder of our own only where none is set."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-graph-"))
    return df.checkpoint(eager=True)


def _distinct(edges: DataFrame) -> DataFrame:
    return checkpoint(edges.select("source", "target").distinct())


def _roots(edges: list[tuple]) -> Iterator[tuple]:
    """(node, least node of its weak component, least node of its strong component)"""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: dict = {}
    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        out.setdefault(a, []).append(b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    number: dict = {}
    low: dict = {}
    strong: dict = {}
    path: list = []
    for start in parent:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        path.append(start)
        todo = [(start, iter(out.get(start, ())))]
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in number:
                    number[y] = low[y] = len(number)
                    path.append(y)
                    todo.append((y, iter(out.get(y, ()))))
                    break
                if y not in strong:
                    low[x] = min(low[x], number[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == number[x]:
                    part = [path.pop()]
                    while part[-1] != x:
                        part.append(path.pop())
                    least = min(part)
                    strong.update(dict.fromkeys(part, least))
    for x in parent:
        yield x, root(x), strong[x]


def _walk(edges: DataFrame) -> DataFrame | None:
    """node, weak, strong of a small graph's nodes that have an edge; None for a larger graph."""
    few = edges.select("source", "target").distinct().limit(SMALL + 1)
    few = checkpoint(few)
    if few.count() > SMALL:
        return None
    kind = few.schema["source"].dataType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.get(kind)
    if arrow is None:
        return None
    schema = pa.schema([(c, arrow) for c in ("node", "weak", "strong")])

    def run(batches):
        held = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        rows = list(_roots(held))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow) for c in zip(*rows)], schema=schema)

    same = few.select("source", F.col("target").cast(kind).alias("target"))
    return checkpoint(same.repartition(1).mapInArrow(run, f"node {kind}, weak {kind}, strong {kind}"))


def _labelled(nodes: DataFrame, walked: DataFrame, label: str) -> DataFrame:
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return ids.join(walked.select("node", F.col(label).alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    walked = _walk(edges)
    return _weak(nodes, edges) if walked is None else _labelled(nodes, walked, "weak")


def _weak(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable when directions are ignored. Large-star and small-star steps: hubs cost a row per neighbour, steps grow with the logarithm of a chain."""
    e = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    e = checkpoint(e)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return ids.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def peel(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without an incoming or an outgoing edge are taken away again and again: none exactly if there is no cycle."""
    e = _distinct(edges)
    n = e.count()
    while n:
        keep = e.select("source").intersect(e.select(F.col("target").alias("source")))
        left = e.join(keep, "source", "left_semi").join(keep.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target")
        e = checkpoint(left)
        m = e.count()
        if m == n:
            break
        n = m
    return e


def is_dag(edges: DataFrame) -> bool:
    if not edges.where("source = target").isEmpty():
        return False
    walked = _walk(edges)
    return peel(edges).isEmpty() if walked is None else walked.groupBy("strong").count().where("count > 1").isEmpty()


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node of each strongly connected component."""
    walked = _walk(edges)
    return _strong(nodes, edges) if walked is None else _labelled(nodes, walked, "strong")


def _strong(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node of each strongly connected component.

    Nodes outside every cycle are their own.  For the others, forward colours (the least node that reaches one) are
    spread; within a colour, what reaches its root backwards is the root's component, and goes."""
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    done: DataFrame | None = None
    e = peel(edges.where("source <> target"))
    while not e.isEmpty():
        inside = e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).distinct()
        colour = _spread(inside.withColumn("c", F.col("node")), e)
        same = e.join(colour.select(F.col("node").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("c").alias("ct")), "target").where("cs = ct").select("source", "target")
        same = checkpoint(same)
        found = checkpoint(_reach(colour.where("node = c").select("node", "c"), same.select(F.col("target").alias("source"), F.col("source").alias("target"))))
        done = found if done is None else done.union(found)
        gone = found.select("node")
        left = e.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        e = peel(left.select("source", "target"))
    if done is None:
        return ids.withColumn("component", F.col("node"))
    return ids.join(done.select("node", F.col("c").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The least colour that reaches each node."""
    colour = checkpoint(colour)
    while True:
        came = edges.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("c").alias("m"))
        new = checkpoint(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        colour = new.select("node", "c")
        if not moved:
            return colour


def _reach(reached: DataFrame, edges: DataFrame) -> DataFrame:
    reached = checkpoint(reached)
    front = reached
    while True:
        new = front.withColumnRenamed("node", "source").join(edges, "source").select(F.col("target").alias("node"), "c").distinct().join(reached, ["node", "c"], "left_anti")
        front = checkpoint(new)
        if front.isEmpty():
            return reached
        reached = checkpoint(reached.union(front))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, weak_components, strong_components, is_dag."""
    ids = checkpoint(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    edges = checkpoint(edges.select("source", "target"))
    loops = not edges.where("source = target").isEmpty()
    walked = _walk(edges)
    if walked is None:
        weak, strong = _weak(ids, edges), _strong(ids, edges)
        dag = not loops and peel(edges).isEmpty()
    else:
        weak, strong = _labelled(ids, walked, "weak"), _labelled(ids, walked, "strong")
        dag = not loops and walked.groupBy("strong").count().where("count > 1").isEmpty()
    number = lambda df: df.agg(F.countDistinct("component")).first()[0]
    row = (ids.count(), edges.count(), number(weak), number(strong), dag)
    return ids.sparkSession.createDataFrame([row], "nodes long, edges long, weak_components long, strong_components long, is_dag boolean")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, outgoing, incoming: parallel edges count each."""
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    both = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    number = both.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return ids.join(number, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outgoing", "incoming")])
