"""Helpers shared by the corpus operators: materialised tables, bounded
broadcasts and distributed connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table with fixed-width rows may be broadcast.
BROADCAST_ROWS = 50_000
#: Copies of a small join side when its rows can't be broadcast and keys are hot.
SALTS = 16
BLANKS = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on find this package where it
    isn't installed (one machine, or a path that all machines share)."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only
    where it is unset and all tasks run in this process (tests) it is set to a
    temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of the tables that were written and not discarded since, oldest first.
WRITTEN: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them again."""
    path = f"{shared_dir(df.sparkSession)}/tallyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete written tables whose readers have written their own rows."""
    for table in tables:
        path = table if isinstance(table, str) else table._written
        spark = SparkSession.active()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def kind_of(df: DataFrame, column: str) -> str:
    """The DDL type of a column, so that ids of any type are carried as they are."""
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame | None:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, else None."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else None


def join_hot(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which a few keys may hold much of `big`.  `small` (unique keys,
    fixed-width rows) is broadcast when it is proven small; otherwise its rows
    are copied once for each salt and `big` is dealt over the salts."""
    if (sent := small_side(small)) is not None:
        return big.join(sent, on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


#: Rows from which a key is dealt over all tasks instead of to one.
HOT_ROWS = 10_000


def join_counted(big: DataFrame, small: DataFrame, on: str, rows: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join with a written table of unique keys, fixed-width rows and the
    number of big's rows that hold the key.  Keys of more than `hot` rows join
    where their rows are: sent to every task if they are proven few, else
    copied for each salt.  All others join by their key."""
    heavy = small.where(F.col(rows) > hot)
    if (n := heavy.limit(BROADCAST_ROWS + 1).count()) == 0:
        return big.join(small.hint("merge"), on)
    if n > BROADCAST_ROWS:
        light = big.join(heavy.select(on), on, "left_anti")
        return join_hot(big, heavy, [on]).unionByName(light.join(small.hint("merge"), on))
    light = big.join(F.broadcast(heavy.select(on)), on, "left_anti")
    return big.join(F.broadcast(heavy), on).unionByName(light.join(small.where(F.col(rows) <= hot).hint("merge"), on))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the
    component is its smallest node.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder and the one before it deleted, only a row count and a checksum
    reach the driver.  A star's centre is dealt over all tasks.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = materialise(join_counted(both, low, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # a node's neighbours here are the least ones that its neighbours saw: at most one a neighbour
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        pairs = join_counted(large, least, "a", "n")
        now = materialise(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(e, low, large, least)
        e = now
        sums = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == seen:
            break
        seen = sums
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
