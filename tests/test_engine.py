"""Registered queries against their SQL, and units with hand-computed results."""

import ast
import glob
import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import panel as P
from tallyloom.operators import performance as A
from tallyloom.operators import similarity
from tallyloom.operators import steps as O
from tallyloom.plans import graph as G
from tallyloom.sources import tables as T
from tallyloom.streaming import replay

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    want = con.sql(entry.oracle_sql()[name])
    cols = want.columns
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
    assert a == b


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_package():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "tallyloom", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            for node in ast.walk(ast.parse(open(path).read())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node), path


def returns(spark, values, bench=None):
    rows = [("2020-%02d-01" % (i + 1), "A", float(v), float(bench[i]) if bench else 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date string, asset string, r double, b double").withColumn("date", F.to_date("date"))


def test_drawdown_episodes_by_hand(spark):
    d = returns(spark, [-0.1, 0.2, -0.5, 1.2, -0.2, 0.1])
    dd = [round(r.dd, 6) for r in P.drawdowns(d).orderBy("date").collect()]
    assert dd == [-0.1, 0.0, -0.5, 0.0, -0.2, -0.12]
    ep = P.episodes(d).orderBy("episode").collect()
    assert [(round(e.depth, 6), e.length, e.to_trough, e.recovery, e.recovered) for e in ep] == [(-0.1, 1, 1, 0, True), (-0.5, 1, 1, 0, True), (-0.2, 2, 1, 1, False)]
    without = P.drawdowns(d, start_at_one=False).orderBy("date").first()
    assert without.dd == 0.0


def test_identities(spark):
    d = returns(spark, [0.03, -0.02, 0.05, -0.04, 0.01, 0.02], [0.02, -0.01, 0.03, -0.05, 0.0, 0.01])
    r, b = F.col("r"), F.col("b")
    x = d.agg(A.omega(r, 0.001).alias("omega"), A.omega_sharpe(r, 0.001).alias("os"), A.m_squared(r, b, 0.001, 12).alias("m2"), A.m_squared_excess(r, b, 0.001, 12).alias("m2e"), A.annualized(b, 12, "arithmetic").alias("rb"), A.total_risk(r, b, 0.001, 12).alias("t"), (F.stddev_pop(r) * 12**0.5).alias("sd"), A.m_squared_sortino(r, b, 0.001, 12).alias("ms"), A.sortino(r, 0.001).alias("so")).first()
    assert x.omega - 1 == pytest.approx(x.os) and x.m2 - x.rb == pytest.approx(x.m2e) and x.t == pytest.approx(x.sd) and x.ms != pytest.approx(x.so)


def test_constant_and_empty_series_give_null(spark):
    r, b = F.col("r"), F.col("b")
    got = returns(spark, [0.0, 0.0, 0.0]).agg(A.sharpe(r, 0.0).alias("a"), A.omega(r, 0.0).alias("c"), A.beta(r, b).alias("d"), A.treynor(r, b, 0.0, 12).alias("e"), A.kelly(r, 0.0).alias("f")).first()
    assert all(v is None for v in got)
    assert returns(spark, [0.1]).limit(0).agg(A.sharpe(r, 0.0), A.annualized(r, 12)).first() == (None, None)


def test_steps_by_hand(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "z", None)], "k int, s string, v double")
    b = spark.createDataFrame([(1, 10.0), (3, 30.0)], "k int, v double")
    m = O.merge(a.groupBy("k").agg(F.max("v").alias("v")), b, ["k"])
    assert sorted((r.k, r.v, r.in_left, r.in_right) for r in m.collect()) == [(1, 10.0, 1, 1), (2, None, 1, 0), (3, 30.0, 0, 1)]
    assert O.rename(a, k="s", S="k").columns == ["s", "k", "v"]
    assert O.keep(a, "V", "nothing").columns == ["v"] and O.drop(a, "K").columns == ["s", "v"]
    assert O.or_sentinel(a.select("k").where("k > 9"), k=-1).collect()[0].k == -1 and O.or_sentinel(a.select("k"), k=-1).count() == 3
    run = {r.s: r.t for r in O.retain_sum(a, "v", ["k"], ["s"], "t").collect()}
    assert run == {"x": 1.0, "y": 3.0, "z": 0.0}
    c = O.compare(a.select("s", "v"), a.select("s", (F.col("v") + 0.5).alias("v")), ["s"], ["v"]).first()
    assert (c.matched, c.v_differs, c.v_abs_diff) == (3, 2, 1.0)
    assert O.label(a, v={"label": "Value"}).schema["v"].metadata == {"label": "Value"}


def test_graphs(spark):
    nodes = [(n, "DATASET", n) for n in "abcde"]
    diamond = [("a", "b", "X"), ("a", "c", "X"), ("b", "d", "X"), ("c", "d", "X")]
    n, e = G.build(spark, nodes, diamond)
    assert {r.id: r.layer for r in G.layers(n, e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0}
    assert {r.id: r.depth for r in G.dependents(e, "a").collect()} == {"b": 1, "c": 1, "d": 2}
    assert {r.id for r in G.dependencies(e, "d", 1).collect()} == {"b", "c"} and not G.has_cycles(e)
    with pytest.raises(ValueError):
        G.build(spark, nodes, [("a", "zz", "X")])
    _, loop = G.build(spark, nodes, [*diamond, ("d", "a", "READS_FROM"), ("e", "e", "X")])
    with pytest.raises(ValueError):
        G.layers(n, loop)
    assert G.has_cycles(loop)
    left, gone = G.break_cycles(n, loop)
    assert not G.has_cycles(left) and {(r.src, r.dst) for r in gone.collect()} >= {("e", "e")}
    assert G.to_dot(n, e).count("->") == 4
    assert sorted(map(tuple, G.from_json(G.to_json(n, e))[0].collect())) == sorted(nodes)


def test_sources(spark, tmp_path):
    df = T.parse_datalines(spark, "1 a 2020-01-02\n2 . .\n", [("k", "double"), ("s", "string"), ("d", "string")], {"d": "yymmdd10."})
    assert [(r.k, r.s, str(r.d)) for r in df.collect()] == [(1.0, "a", "2020-01-02"), (2.0, None, "None")]
    T.write_csv(df, str(tmp_path / "c"))
    (tmp_path / "c" / "bad.csv").write_text("k,s,d\nnot a number,x,y\n")
    assert len(T.read_csv(spark, str(tmp_path / "c"), "k double, s string, d date", drop_malformed=True).collect()) == 2
    lib = T.Library(spark)
    lib.put("A", df)
    lib.put("work.a", df.limit(1))
    assert lib.versions("a") == 2 and lib.get("WORK.A", 0).count() == 2 and "a" in lib and "b" not in lib
    with pytest.raises(KeyError):
        lib.get("b")


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, "end", 0.0)], events.schema).select(F.lit("2100-01-01").cast("timestamp").alias("ts"), "event_type", "value").write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay.windowed_summary(replay.read_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double", 10), "ts", ["event_type"], {"value": "total"}, "1 day", "60 days")
    query = replay.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    got = {(str(r.window_start), r.event_type): (r.n, round(r.total, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(str(r.window_start), r.event_type): (r.n, round(r.total, 6)) for r in replay.windowed_summary(events, "ts", ["event_type"], {"value": "total"}).collect()}
    assert got == want


def test_jaccard_top_gives_k_rows_a_query_and_task_whatever_the_sizes():
    rng = np.random.default_rng(4)
    words = [np.unique((60 * rng.random(rng.integers(0, 50)) ** 2).astype(np.int64)) for _ in range(300)]
    words[::9] = [words[1]] * len(words[::9])
    ids = rng.permutation(300)
    batches = [pa.record_batch({"key": pa.array(ids[i : i + 70]), "words": pa.array([w.tolist() for w in words[i : i + 70]], pa.list_(pa.int64()))}) for i in range(0, 300, 70)]
    asked = np.flatnonzero(ids % 20 == 0)
    got = [row for b in similarity._alike(ids[asked], [words[i] for i in asked], 5, 0.0)(batches) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = []
    for q in asked:
        alike = [(-round(len(np.intersect1d(words[q], w)) / max(len(np.union1d(words[q], w)), 1), 9), int(i)) for i, w in zip(ids, words, strict=True) if i != ids[q]]
        want += [(int(ids[q]), i, -j) for j, i in sorted(alike)[:5] if j < 0]
    assert sorted(got) == sorted(want)
