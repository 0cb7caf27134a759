"""Lineage graphs as nodes(id, type, name) and edges(src, dst, type) DataFrames.

Edges follow the data: dataset to the step that reads it, step to the dataset
that it writes.  Reachability and layers are frontier joins: each round joins
only what the round before found, and ends when that is empty.  Every
round is written out, so the plan of a deep graph doesn't grow with its depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cut import cut

# Node and edge types.
NODE_TYPES = ("DATASET", "DATA_STEP", "PROC_STEP", "MACRO", "MACRO_VARIABLE", "LIBRARY", "FILE")
EDGE_TYPES = ("READS_FROM", "WRITES_TO", "USES_VARIABLE", "DEFINES_VARIABLE", "CALLS", "PROC_INPUT", "PROC_OUTPUT", "DEPENDS_ON_FILE")
#: Which edge a cycle is broken at first, by type.
WEAKNESS = {"READS_FROM": 1, "USES_VARIABLE": 1, "PROC_INPUT": 2, "DEFINES_VARIABLE": 2, "WRITES_TO": 3, "PROC_OUTPUT": 3, "CALLS": 4}


def build(spark: SparkSession, nodes: Iterable[tuple[str, str, str]], edges: Iterable[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, type); of parallel edges the
    last type stays; an edge with an unknown end raises ValueError."""
    nodes, last = list(nodes), {(s, d): t for s, d, t in edges}
    known = {n for n, _, _ in nodes}
    if unknown := sorted({x for e in last for x in e} - known):
        raise ValueError(f"unknown nodes: {', '.join(unknown)}")
    return spark.createDataFrame(nodes, "id string, type string, name string"), spark.createDataFrame([(s, d, t) for (s, d), t in last.items()], "src string, dst string, type string")


def closure(edges: DataFrame, depth: int | None = None, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(src, dst, depth): pairs joined by a path, with the shortest path's length."""
    step = cut(edges.select("src", "dst").distinct())
    found = step.withColumn("depth", F.lit(1))
    front, d = found, 1
    while depth is None or d < depth:
        d += 1
        more = front.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = cut(more.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def dependencies(edges: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    """(id, depth): what the node depends on, the nearest first; the node itself only if it's on a cycle."""
    return _walk(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), node, depth)


def dependents(edges: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    return _walk(edges, node, depth)


def _walk(edges: DataFrame, node: str, depth: int | None) -> DataFrame:
    step = edges.select("src", "dst").distinct()
    found = cut(step.where(F.col("src") == node).select(F.col("dst").alias("id")).withColumn("depth", F.lit(1)))
    front, d = found, 1
    while depth is None or d < depth:
        d += 1
        front = cut(front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def layers(nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, layer): length of the longest path from a root; a cycle raises ValueError."""
    step = edges.select("src", "dst").distinct()
    out, left, n = None, cut(nodes.select("id").distinct()), 0
    while not left.isEmpty():
        blocked = step.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        ready = cut(left.join(blocked, "id", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        tagged = ready.withColumn("layer", F.lit(n))
        out = tagged if out is None else out.unionByName(tagged)
        left, n = cut(left.join(ready, "id", "left_anti")), n + 1
    return nodes.select("id").withColumn("layer", F.lit(0)).limit(0) if out is None else out


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return layers(nodes, edges).orderBy("layer", "id")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id) of nodes that reach themselves."""
    return closure(edges).where("src = dst").select(F.col("src").alias("id"))


def has_cycles(edges: DataFrame) -> bool:
    return not on_cycles(edges).isEmpty()


def find_cycles(edges: DataFrame, longest: int = 16) -> DataFrame:
    """(cycle): simple cycles of up to `longest` nodes, each once, from its smallest node on."""
    step = edges.select("src", "dst").distinct()
    paths = step.where("src <= dst").select(F.array("src").alias("path"), F.col("dst").alias("tip"))
    out = None
    for _ in range(longest):
        closed = paths.where(F.col("tip") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        open_ = paths.where(F.col("tip") > F.col("path")[0]).where(~F.array_contains("path", F.col("tip")))
        paths = cut(open_.join(step, F.col("tip") == F.col("src")).where(F.col("dst") >= F.col("path")[0]).select(F.array_append("path", F.col("tip")).alias("path"), F.col("dst").alias("tip")))
        if paths.isEmpty():
            break
    return out.distinct()


def break_cycles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of an acyclic graph, and the removed ones: self-loops, then, as
    long as there is a cycle, the edge from a dataset into the step that
    rewrites it, or else the weakest edge by type and name."""
    gone = edges.where("src = dst")
    left = edges.where("src <> dst")
    datasets = nodes.where("type = 'DATASET'").select(F.col("id").alias("src"))
    rank = F.create_map(*[F.lit(x) for kv in WEAKNESS.items() for x in kv])
    while True:
        on = on_cycles(left)
        inside = left.join(on.select(F.col("id").alias("src")), "src", "left_semi").join(on.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")
        if inside.isEmpty():
            return left, gone
        back = left.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        own = inside.join(back, ["src", "dst"], "left_semi").join(datasets, "src", "left_semi").withColumn("rank", F.lit(0))
        every = inside.withColumn("rank", F.coalesce(rank[F.col("type")], F.lit(5)))
        worst = own.unionByName(every).orderBy("rank", "src", "dst").limit(1).drop("rank").select("src", "dst", "type")
        pick = worst.first()
        worst = edges.sparkSession.createDataFrame([tuple(pick)], "src string, dst string, type string")
        gone, left = gone.unionByName(worst), left.join(worst.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "type")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids.select("id"), "id", "left_semi"), inside.select(*edges.columns)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes and edges in all and by type, roots and leaves."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    by = lambda df, kind: df.groupBy(F.concat(F.lit(f"{kind}:"), "type").alias("what")).agg(F.count("*").alias("n"))
    return count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(by(nodes, "node")).unionByName(by(edges, "edge")).unionByName(count(roots(nodes, edges), "roots")).unionByName(count(leaves(nodes, edges), "leaves"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) rows; from_json reads them back."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("id").alias("node_id"), F.col("type").alias("node_type"), "name")).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type")).alias("json")))


def from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = rows.where("kind = 'node'").select(F.from_json("json", "node_id string, node_type string, name string").alias("j")).select(F.col("j.node_id").alias("id"), F.col("j.node_type").alias("type"), "j.name")
    e = rows.where("kind = 'edge'").select(F.from_json("json", "`from` string, `to` string, type string").alias("j")).select(F.col("j.from").alias("src"), F.col("j.to").alias("dst"), "j.type")
    return n, e


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """DOT text; for graphs of programs, which are small."""
    shape = {"DATASET": "cylinder", "MACRO_VARIABLE": "diamond", "FILE": "note"}
    lines = [f'  "{r.id}" [label="{r.name}" shape={shape.get(r.type, "box")}];' for r in nodes.orderBy("id").collect()]
    lines += [f'  "{r.src}" -> "{r.dst}" [label="{r.type}"];' for r in edges.orderBy("src", "dst").collect()]
    return "\n".join(["digraph lineage {", "  rankdir=LR;", *lines, "}"])


def lifecycle(steps: DataFrame) -> DataFrame:
    """Checks over (seq, step, dataset, action) with action read or write:
    (dataset, seq, problem) where a dataset is read before it is written,
    written again before anyone read it, or never read."""
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy("seq", "action")
    first_write = F.min(F.when(F.col("action") == "write", F.col("seq"))).over(Window.partitionBy("dataset"))
    then, before = F.lead("action").over(w), F.lag("action").over(w)
    tagged = steps.select("dataset", "seq", "action", first_write.alias("w0"), then.alias("then"), before.alias("before"))
    early = tagged.where("action = 'read' AND w0 IS NOT NULL AND seq < w0").select("dataset", "seq", F.lit("read before written").alias("problem"))
    lost = tagged.where("action = 'write' AND then = 'write'").select("dataset", "seq", F.lit("overwritten unread").alias("problem"))
    unused = tagged.where("action = 'write' AND then IS NULL").select("dataset", "seq", F.lit("never read").alias("problem"))
    missing = tagged.where("action = 'read' AND w0 IS NULL").select("dataset", "seq", F.lit("never written").alias("problem"))
    return early.unionByName(lost).unionByName(unused).unionByName(missing)
