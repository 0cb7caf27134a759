"""Long price and return panels, and what needs their order in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(asset: str = "asset", date: str = "date"):
    return Window.partitionBy(asset).orderBy(date)


def so_far(asset: str = "asset", date: str = "date"):
    return by_time(asset, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def monthly_prices(lineitem: DataFrame) -> DataFrame:
    """(date, asset, price): mean extended price of each return flag and, as
    MKT, of all rows; one scan, one shuffle of partial sums."""
    cells = lineitem.groupBy(F.trunc("l_shipdate", "MM").alias("date"), F.col("l_returnflag").alias("asset")).agg(F.sum("l_extendedprice").alias("s"), F.count("l_extendedprice").alias("n"))
    rows = cells.select("date", F.explode(F.array("asset", F.lit("MKT"))).alias("asset"), "s", "n")
    return rows.groupBy("date", "asset").agg((F.sum("s") / F.sum("n")).alias("price"))


def daily_prices(events: DataFrame) -> DataFrame:
    """(date, asset, price): mean value of each event type by day."""
    return events.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("price"))


def returns(prices: DataFrame, method: str = "discrete") -> DataFrame:
    """(date, asset, r) without each asset's first period."""
    last = F.lag("price").over(by_time())
    r = F.col("price") / last - 1 if method == "discrete" else F.log("price") - F.log(last)
    return prices.select("date", "asset", r.alias("r")).where(F.col("r").isNotNull())


def with_benchmark(rets: DataFrame, benchmark: str = "MKT") -> DataFrame:
    """(date, asset, r, b): the benchmark's return beside every other asset's,
    by a window over the date instead of a join."""
    b = F.max(F.when(F.col("asset") == benchmark, F.col("r"))).over(Window.partitionBy("date"))
    return rets.withColumn("b", b).where((F.col("asset") != benchmark) & F.col("b").isNotNull())


def wealth(r: Column = None) -> Column:
    return F.exp(F.sum(F.log(1 + (F.col("r") if r is None else r))).over(so_far()))


def cumulative(rets: DataFrame, method: str = "geometric") -> DataFrame:
    total = wealth() - 1 if method == "geometric" else F.sum("r").over(so_far())
    return rets.select("date", "asset", total.alias("cumulative"))


def drawdowns(rets: DataFrame, start_at_one: bool = True) -> DataFrame:
    """(date, asset, r, dd): loss against the highest wealth so far."""
    w = rets.withColumn("w", wealth())
    peak = F.max("w").over(so_far())
    peak = F.greatest(F.lit(1.0), peak) if start_at_one else peak
    # wealth is a product of floats: what is below its peak by rounding alone is at its peak
    dd = F.col("w") / peak - 1
    return w.select("date", "asset", "r", F.when(dd > -1e-12, 0.0).otherwise(dd).alias("dd"))


def episodes(rets: DataFrame) -> DataFrame:
    """One row for each drawdown: asset, episode, begin, trough, end, depth,
    length, to_trough, recovery, recovered.  The last one may be open."""
    dd = drawdowns(rets).withColumn("at", F.row_number().over(by_time())).withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    tagged = dd.withColumn("island", F.sum((F.col("dd") == 0).cast("long")).over(so_far()))
    to_trough = (F.min_by("at", "dd") - F.min("at") + 1).cast("long")
    out = tagged.where("dd < 0").groupBy("asset", "island").agg(F.min("date").alias("begin"), F.min_by("date", "dd").alias("trough"), F.max("date").alias("end"), F.min("dd").alias("depth"), F.count("*").alias("length"), to_trough.alias("to_trough"), (F.max("at") < F.max("n")).alias("recovered"))
    episode = F.row_number().over(Window.partitionBy("asset").orderBy("begin"))
    return out.select("asset", episode.alias("episode"), "begin", "trough", "end", "depth", "length", "to_trough", (F.col("length") - F.col("to_trough")).alias("recovery"), "recovered")


def pairs(rets: DataFrame) -> DataFrame:
    """(date, a1, a2, r1, r2): all ordered pairs of assets of a date."""
    x = rets.select("date", F.col("asset").alias("a1"), F.col("r").alias("r1"))
    y = rets.select("date", F.col("asset").alias("a2"), F.col("r").alias("r2"))
    return x.join(y, "date")
