"""Graph and retrieval operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity
from . import graph as G

Query = Callable[[SparkSession, str], DataFrame]

# The lineage of the transaction pipeline.
NODES = [("raw", "DATASET", "staging.raw_transactions"), ("clean", "DATASET", "staging.clean"), ("freq", "DATASET", "work.freq"), ("daily", "DATASET", "mart.daily_sales"), ("extract", "DATA_STEP", "extract"), ("transform", "DATA_STEP", "transform"), ("freqs", "PROC_STEP", "freq"), ("load", "PROC_STEP", "summary"), ("print", "PROC_STEP", "print"), ("rate", "MACRO_VARIABLE", "rate"), ("setup", "MACRO", "setup")]
EDGES = [("extract", "raw", "WRITES_TO"), ("raw", "transform", "READS_FROM"), ("transform", "clean", "WRITES_TO"), ("clean", "freqs", "PROC_INPUT"), ("freqs", "freq", "PROC_OUTPUT"), ("clean", "load", "PROC_INPUT"), ("load", "daily", "PROC_OUTPUT"), ("daily", "print", "PROC_INPUT"), ("rate", "transform", "USES_VARIABLE"), ("setup", "rate", "DEFINES_VARIABLE")]
LOOPED = [*EDGES, ("load", "clean", "WRITES_TO"), ("print", "print", "CALLS")]
STEPS = [(1, "extract", "raw", "write"), (2, "transform", "raw", "read"), (2, "transform", "clean", "write"), (3, "load", "clean", "read"), (3, "load", "daily", "write"), (4, "peek", "late", "read"), (5, "make", "late", "write"), (6, "make", "late", "write"), (7, "use", "nowhere", "read")]


def _values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS v({names}))"


_N, _E, _L = _values(NODES, "id, type, name"), _values(EDGES, "src, dst, type"), _values(LOOPED, "src, dst, type")
_WALK = "WITH RECURSIVE e AS (SELECT {a} AS a, {b} AS b FROM " + _E + "), w AS (SELECT b AS id, 1 AS depth FROM e WHERE a = '{node}' UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.id) SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id"


def _graph(spark: SparkSession, edges: list[tuple] = EDGES) -> tuple[DataFrame, DataFrame]:
    return G.build(spark, NODES, edges)


def _queries(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 20 == 0)


QUERIES: dict[str, Query] = {
    "g01_edges": lambda s, _: _graph(s)[1],
    "g02_nodes_by_type": lambda s, _: _graph(s)[0].groupBy("type").agg(F.count("*").alias("n")),
    "g03_dependencies": lambda s, _: G.dependencies(_graph(s)[1], "print"),
    "g03_dependents": lambda s, _: G.dependents(_graph(s)[1], "raw"),
    "g03_dependencies_depth": lambda s, _: G.dependencies(_graph(s)[1], "load", 2),
    "g04_topological_order": lambda s, _: G.topological_order(*_graph(s)),
    "g05_find_cycles": lambda s, _: G.find_cycles(_graph(s, LOOPED)[1]).select(F.concat_ws(">", "cycle").alias("cycle")),
    "g06_layers": lambda s, _: G.layers(*_graph(s)),
    "g07_on_cycles": lambda s, _: G.on_cycles(_graph(s, LOOPED)[1]),
    "g08_break_cycles": lambda s, _: G.break_cycles(*_graph(s, LOOPED))[1].select("src", "dst"),
    "g09_subgraph": lambda s, _: G.subgraph(*_graph(s), G.dependents(_graph(s)[1], "clean"))[1],
    "g10_roots_leaves": lambda s, _: G.roots(*_graph(s)).select("id", F.lit("root").alias("kind")).unionByName(G.leaves(*_graph(s)).select("id", F.lit("leaf").alias("kind"))),
    "g11_edge_counts": lambda s, _: _graph(s)[1].groupBy("type").agg(F.count("*").alias("n")),
    "g12_json_round_trip": lambda s, _: G.from_json(G.to_json(*_graph(s)))[1],
    "g15_summary": lambda s, _: G.summary(*_graph(s)),
    "g22_lifecycle": lambda s, _: G.lifecycle(s.createDataFrame(STEPS, "seq int, step string, dataset string, action string")),
    "v01_jaccard": lambda s, d: similarity.jaccard_top(s.read.parquet(f"{d}/documents.parquet"), _queries(s.read.parquet(f"{d}/documents.parquet"), "doc_id"), 5).withColumn("jaccard", F.round("jaccard", 6)),
    "v02_cosine": lambda s, d: similarity.cosine_top(s.read.parquet(f"{d}/embeddings.parquet"), _queries(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id"), 5, -1.0).withColumn("cosine", F.round("cosine", 6)),
}
_CLOSURE = "WITH RECURSIVE w AS (SELECT src, dst FROM {e} UNION SELECT w.src, e.dst FROM w JOIN {e} e ON e.src = w.dst) "
_LAYERS = "WITH RECURSIVE w AS (SELECT id, 0 AS layer FROM " + _N + " n WHERE NOT EXISTS (SELECT 1 FROM " + _E + " e WHERE e.dst = n.id) UNION SELECT e.dst, layer + 1 FROM w JOIN " + _E + " e ON e.src = w.id) SELECT id, CAST(max(layer) AS INT) AS layer FROM w GROUP BY id"
_bag = lambda t: f"list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: x <> ''))"
ORACLE: dict[str, str] = {
    "g01_edges": f"SELECT src, dst, type FROM {_E}",
    "g02_nodes_by_type": f"SELECT type, count(*) AS n FROM {_N} GROUP BY type",
    "g03_dependencies": _WALK.format(a="dst", b="src", node="print"),
    "g03_dependents": _WALK.format(a="src", b="dst", node="raw"),
    "g03_dependencies_depth": _WALK.format(a="dst", b="src", node="load") + " HAVING min(depth) <= 2",
    "g04_topological_order": _LAYERS,
    "g05_find_cycles": "SELECT * FROM (VALUES ('clean>load'), ('print')) AS v(cycle)",
    "g06_layers": _LAYERS,
    "g07_on_cycles": _CLOSURE.format(e=_L) + "SELECT src AS id FROM w WHERE src = dst",
    "g08_break_cycles": "SELECT * FROM (VALUES ('print', 'print'), ('clean', 'load')) AS v(src, dst)",
    "g09_subgraph": _CLOSURE.format(e=_E) + f"SELECT src, dst, type FROM {_E} e WHERE src IN (SELECT dst FROM w WHERE src = 'clean') AND dst IN (SELECT dst FROM w WHERE src = 'clean')",
    "g10_roots_leaves": f"SELECT id, 'root' AS kind FROM {_N} WHERE id NOT IN (SELECT dst FROM {_E}) UNION ALL SELECT id, 'leaf' FROM {_N} WHERE id NOT IN (SELECT src FROM {_E})",
    "g11_edge_counts": f"SELECT type, count(*) AS n FROM {_E} GROUP BY type",
    "g12_json_round_trip": f"SELECT src, dst, type FROM {_E}",
    "g15_summary": f"SELECT 'nodes' AS what, count(*) AS n FROM {_N} UNION ALL SELECT 'edges', count(*) FROM {_E} UNION ALL SELECT 'node:' || type, count(*) FROM {_N} GROUP BY type UNION ALL SELECT 'edge:' || type, count(*) FROM {_E} GROUP BY type UNION ALL SELECT 'roots', count(*) FROM {_N} WHERE id NOT IN (SELECT dst FROM {_E}) UNION ALL SELECT 'leaves', count(*) FROM {_N} WHERE id NOT IN (SELECT src FROM {_E})",
    "g22_lifecycle": "SELECT dataset, CAST(seq AS INT) AS seq, problem FROM (VALUES ('late', 4, 'read before written'), ('late', 5, 'overwritten unread'), ('late', 6, 'never read'), ('daily', 3, 'never read'), ('nowhere', 7, 'never written')) AS v(dataset, seq, problem)",
    "v01_jaccard": f"WITH t AS (SELECT doc_id, {_bag('text')} AS w FROM documents), s AS (SELECT q.doc_id AS query, d.doc_id, len(list_intersect(q.w, d.w)) AS c, len(q.w) + len(d.w) AS n FROM t q JOIN t d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0), r AS (SELECT query, doc_id, round(c / (n - c), 9) AS j, row_number() OVER (PARTITION BY query ORDER BY round(c / (n - c), 9) DESC, doc_id) AS rank FROM s WHERE c > 0) SELECT query, doc_id, round(j, 6) AS jaccard, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "v02_cosine": "WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
}
