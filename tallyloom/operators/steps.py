"""Row steps, merges, sorting and summaries of the step language over DataFrames.

Names are case-insensitive, unknown names in KEEP and DROP are ignored, and
missing values are nulls.  Nothing here triggers a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep(df: DataFrame, *names: str) -> DataFrame:
    wanted = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() in wanted])


def drop(df: DataFrame, *names: str) -> DataFrame:
    gone = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in gone])


def rename(df: DataFrame, **new: str) -> DataFrame:
    """All at once, so names may be swapped."""
    by_lower = {k.lower(): v for k, v in new.items()}
    return df.select([F.col(c).alias(by_lower.get(c.lower(), c)) for c in df.columns])


def stack(*frames: DataFrame) -> DataFrame:
    """SET of several datasets: rows of all, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label(df: DataFrame, **info: dict) -> DataFrame:
    """Column metadata such as label, format and length."""
    return reduce(lambda d, kv: d.withMetadata(kv[0], kv[1]), info.items(), df)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    gone = {e.lower() for e in exclude}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name.lower() not in gone]


def to_character(df: DataFrame, fmt: str = "%.4f", exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as formatted text."""
    numeric = set(numeric_columns(df, exclude))
    return df.select([F.trim(F.format_string(fmt, F.col(c).cast("double"))).alias(c) if c in numeric else F.col(c) for c in df.columns])


def retain_sum(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Sum statement: a running total within BY groups; nulls add nothing."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))


def first_last(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """first_ and last_ flags of the BY group in the given order (ties by all columns are the caller's)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("first_", (F.row_number().over(w) == 1).cast("int")).withColumn("last_", F.lead(F.lit(1)).over(w).isNull().cast("int"))


def merge(left: DataFrame, right: DataFrame, by: Sequence[str], many: bool = False, order: tuple[Sequence[Column], Sequence[Column]] = ((), ())) -> DataFrame:
    """MERGE; BY with in_left and in_right flags.

    Shared columns take the last-listed dataset's value if it isn't null.  With
    many=True rows of a key are paired one by one, in the order given for each
    side (then by all columns), and the shorter side repeats its last row, so no
    key multiplies.
    """
    a, b = left.withColumn("in_left", F.lit(1)), right.withColumn("in_right", F.lit(1))
    keys = list(by)
    if many:
        w = Window.partitionBy(*keys)
        number = lambda d, name, by: d.withColumn(name, F.row_number().over(w.orderBy(*by, *[F.col(c) for c in d.columns if c not in keys]))).withColumn(name + "n", F.count("*").over(w))
        a, b = number(a, "__a", order[0]), number(b, "__b", order[1])
        sizes = a.groupBy(*keys).agg(F.max("__an").alias("__x")).join(b.groupBy(*keys).agg(F.max("__bn").alias("__y")), keys, "full")
        slots = sizes.withColumn("__k", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("__x", F.lit(0)), F.coalesce("__y", F.lit(0))))))
        slots = slots.withColumn("__a", F.least("__k", "__x").cast("int")).withColumn("__b", F.least("__k", "__y").cast("int")).select(*keys, "__a", "__b")
        a = slots.join(a.drop("__an"), [*keys, "__a"], "left").select(*[c for c in (*keys, "__a", "__b", *[c for c in a.columns if c not in (*keys, "__a", "__an")])])
        b, keys = b.drop("__bn"), [*keys, "__b"]
        joined = a.alias("l").join(b.alias("r"), keys, "left")
    else:
        joined = a.alias("l").join(b.alias("r"), keys, "full")
    shared = [c for c in left.columns if c in right.columns and c not in by]
    cols = [F.col(c) for c in by] + [F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) if c in shared else F.col(f"l.{c}") for c in left.columns if c not in by]
    cols += [F.col(f"r.{c}") for c in right.columns if c not in by and c not in shared]
    return joined.select(*cols, F.coalesce("in_left", F.lit(0)).alias("in_left"), F.coalesce("in_right", F.lit(0)).alias("in_right"))


def update(master: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """UPDATE: values of the transaction that aren't null replace the master's; new keys are added."""
    return merge(master, changes, by).drop("in_left", "in_right")


def hash_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int = 100_000) -> DataFrame:
    """Left lookup; the table is sent to all tasks if it is proven to have at most `rows` rows."""
    small = table.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(table) if small else table, list(keys), "left")


def sort_nodupkey(df: DataFrame, by: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row for each BY key, the first in the given order."""
    w = Window.partitionBy(*by).orderBy(*(order or by))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_STATS = {"n": F.count, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}


def means(df: DataFrame, var: Sequence[str], stats: Sequence[str] = ("n", "mean", "std", "min", "max"), cls: Sequence[str] = ()) -> DataFrame:
    """PROC MEANS with NWAY: one row for each combination of class values."""
    return df.groupBy(*cls).agg(*[_STATS[s](v).alias(f"{v}_{s}") for v in var for s in stats])


def summary(df: DataFrame, cls: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """PROC SUMMARY without NWAY: all subsets of the class variables, with
    _TYPE_ (bit set for each class variable used, the last the lowest) and _FREQ_."""
    full = (1 << len(cls)) - 1
    out = df.cube(*cls).agg((F.lit(full) - F.grouping_id()).cast("long").alias("_TYPE_"), F.count("*").alias("_FREQ_"), *[F.sum(v).alias(n) for v, n in sums.items()])
    return out


def freq(df: DataFrame, *tables: str) -> DataFrame:
    """PROC FREQ, one-way: table, level, count, percent, cumulative count and percent; one row for each level."""
    levels = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col(t).cast("string").alias("level")) for t in tables])).alias("x")).select("x.*")
    counted = levels.groupBy("table", "level").agg(F.count("*").alias("count"))
    w = Window.partitionBy("table")
    upto = w.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("count").over(w)
    run = F.sum("count").over(upto)
    return counted.select("table", "level", "count", (100.0 * F.col("count") / total).alias("percent"), run.alias("cum_count"), (100.0 * run / total).alias("cum_percent"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """PROC FREQ a*b: count, percent of all, of the row and of the column."""
    n = df.groupBy(a, b).agg(F.count("*").alias("count"))
    share = lambda *by: 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    total = n.agg(F.sum("count").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(a, b, "count", (100.0 * F.col("count") / F.col("total")).alias("percent"), share(a).alias("row_percent"), share(b).alias("col_percent"))


def normalize(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.0, name: str = "share") -> DataFrame:
    """value / (sum(value) / k), over all rows or within BY groups; the sums are
    aggregated first, so no window over all rows lands in one task."""
    total = df.groupBy(*by).agg((F.sum(value) / k).alias("__total"))
    joined = df.join(total, list(by), "left") if by else df.crossJoin(F.broadcast(total))
    return joined.withColumn(name, F.col(value) / F.nullif("__total", F.lit(0.0))).drop("__total")


def transpose(df: DataFrame, by: Sequence[str], id_: str, var: str, values: Sequence[str]) -> DataFrame:
    """PROC TRANSPOSE: one column for each listed value of the ID variable."""
    return df.groupBy(*by).pivot(id_, list(values)).agg(F.first(var, ignorenulls=True))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def compare(a: DataFrame, b: DataFrame, by: Sequence[str], columns: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """PROC COMPARE: one row with rows on either side alone, and for each column
    the values that differ by more than tol and the sum of absolute differences."""
    x, y = a.withColumn("__x", F.lit(1)), b.withColumn("__y", F.lit(1))
    j = x.alias("a").join(y.alias("b"), list(by), "full")
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    diff = {c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns}
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    aggs = [n(F.col("__y").isNull()).alias("only_left"), n(F.col("__x").isNull()).alias("only_right"), n(both).alias("matched")]
    for c, d in diff.items():
        aggs += [n(both & ((d > tol) | (F.col(f"a.{c}").isNull() != F.col(f"b.{c}").isNull()))).alias(f"{c}_differs"), F.coalesce(F.sum(d), F.lit(0.0)).alias(f"{c}_abs_diff")]
    return j.agg(*aggs)


def or_sentinel(df: DataFrame, **sentinel) -> DataFrame:
    """df, or one row of sentinel values if df is empty; no counting job."""
    one = df.sparkSession.range(1).select(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in sentinel.items()], F.lit(1).alias("__k"))
    flagged = df.agg(F.count("*").alias("__n"))
    return df.unionByName(one.crossJoin(F.broadcast(flagged)).where("__n = 0").select(*df.columns))


def do_loop(df: DataFrame, var: str, start: int | Column, stop: int | Column, step: int = 1) -> DataFrame:
    """DO var = start TO stop BY step; OUTPUT: a row for each turn."""
    s, e = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    ok = s <= e if step > 0 else s >= e
    return df.where(ok).withColumn(var, F.explode(F.sequence(s, e, F.lit(step))))
