"""Performance measures over the monthly panel of lineitem, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import moments as M
from ..operators import panel as P
from ..operators import performance as A

S, RF, MAR = 12, 0.0005, 0.0005
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PANEL = """WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS asset, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
pm AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
ra AS (SELECT * FROM (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM p) WHERE r IS NOT NULL),
rm AS (SELECT * FROM (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS b FROM pm) WHERE b IS NOT NULL),
rb AS (SELECT ra.date, asset, r, b FROM ra JOIN rm USING (date)),
rc AS (SELECT *, avg(r) OVER (PARTITION BY asset) AS mr, avg(b) OVER (PARTITION BY asset) AS mb FROM rb),
w AS (SELECT date, asset, r, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) AS w FROM rb),
dd0 AS (SELECT date, asset, r, w, w / greatest(1.0, max(w) OVER (PARTITION BY asset ORDER BY date)) - 1 AS d FROM w),
dd AS (SELECT date, asset, r, w, CASE WHEN d > -1e-12 THEN 0.0 ELSE d END AS dd, row_number() OVER (PARTITION BY asset ORDER BY date) AS pos FROM dd0),
isl AS (SELECT *, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date) AS island, max(pos) OVER (PARTITION BY asset) AS n FROM dd),
ep0 AS (SELECT asset, island, min(date) AS begin, arg_min(date, dd) AS trough, max(date) AS "end", min(dd) AS depth, count(*) AS length, arg_min(pos, dd) - min(pos) + 1 AS to_trough, max(pos) AS stop, any_value(n) AS n FROM isl WHERE dd < 0 GROUP BY asset, island),
ep AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY begin) AS episode, begin, trough, "end", depth, length, to_trough, length - to_trough AS recovery, stop < n AS recovered FROM ep0)
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.monthly_prices(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_benchmark(P.returns(prices(spark, sf_dir)))


def shown(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def said(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6) + 0.0"


r: Column
b: Column


def _bind() -> None:
    """Columns need a running session, so they are made when a query is."""
    global r, b
    r, b = F.col("r"), F.col("b")


def rows(key: str, build: Callable[[DataFrame], DataFrame], sql: str, source: Query = returns) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _bind()
        return build(source(spark, sf_dir))

    QUERIES[key] = run
    ORACLE[key] = PANEL + sql


def measure(key: str, **columns: tuple[Callable[[], Column], str]) -> None:
    """One value for each asset and column: a Column over (r, b), and its SQL over rc."""
    rows(key, lambda df: df.groupBy("asset").agg(*[shown(c()).alias(name) for name, (c, _) in columns.items()]), f"SELECT asset, {', '.join(f'{said(q)} AS {name}' for name, (_, q) in columns.items())} FROM rc GROUP BY asset")


_x, _y = f"(b - {RF})", f"(r - {RF})"
_sd, _sdp = "stddev_samp(r)", "stddev_pop(r)"
_year = lambda x: f"(exp({S} * avg(ln(1 + {x}))) - 1)"
_dn = lambda x, k, t=MAR: f"avg(pow(greatest({t} - {x}, 0), {k}))"
_up = lambda x, k, t=MAR: f"avg(pow(greatest({x} - {t}, 0), {k}))"
_beta, _alpha = f"regr_slope({_y}, {_x})", f"regr_intercept({_y}, {_x})"
_c = lambda i, j: f"avg(pow(r - mr, {i}) * pow(b - mb, {j}))"
_skew, _kurt = f"({_c(3, 0)} / pow({_c(2, 0)}, 1.5))", f"({_c(4, 0)} / pow({_c(2, 0)}, 2))"
_rfy = f"(pow(1 + {RF}, {S}) - 1)"
_sharpe = f"(avg({_y}) / {_sd} * sqrt({S}))"
_resid = f"greatest(var_pop({_y}) - pow(covar_pop({_y}, {_x}), 2) / var_pop({_x}), 0)"
_sys, _spec = f"({_beta} * stddev_pop(b) * sqrt({S}))", f"(sqrt({_resid}) * sqrt({S}))"

# --- returns ---------------------------------------------------------------
_R = "SELECT date, asset, {} AS {} FROM rb"
rows("r01_return_discrete", lambda d: d.select("date", "asset", shown(r).alias("ret")), _R.format(said("r"), "ret"))
rows(
    "r02_return_log",
    lambda d: P.returns(d, "log").where("asset <> 'MKT'").select("date", "asset", shown(r).alias("ret")),
    f"SELECT * FROM (SELECT date, asset, {said('ln(price) - ln(lag(price) OVER (PARTITION BY asset ORDER BY date))')} AS ret FROM p) WHERE ret IS NOT NULL",
    prices,
)
rows("r03_return_cumulative", lambda d: P.cumulative(d).select("date", "asset", shown(F.col("cumulative")).alias("cumulative")), f"SELECT date, asset, {said('w - 1')} AS cumulative FROM w")
rows("r04_return_cumulative_log", lambda d: P.cumulative(d, "log").select("date", "asset", shown(F.col("cumulative")).alias("cumulative")), f"SELECT date, asset, {said('sum(r) OVER (PARTITION BY asset ORDER BY date)')} AS cumulative FROM rb")
for _key, _part in (("r05_return_yearly", ("year",)), ("r06_return_quarterly", ("year", "quarter")), ("r07_return_monthly", ("year", "month"))):
    _agg = (lambda: A.accumulated(r), "exp(sum(ln(1 + r))) - 1") if _key != "r06_return_quarterly" else (lambda: F.sum(A.log_growth(r)), "sum(ln(1 + r))")
    rows(
        _key,
        lambda d, part=_part, agg=_agg: d.groupBy("asset", *[getattr(F, p)("date").cast("int").alias(p) for p in part]).agg(shown(agg[0]()).alias("ret")),
        f"SELECT asset, {', '.join(f'CAST({p}(date) AS INT) AS {p}' for p in _part)}, {said(_agg[1])} AS ret FROM rb GROUP BY asset, {', '.join(f'{p}(date)' for p in _part)}",
    )
rows("r08_return_excess", lambda d: d.select("date", "asset", shown(r - RF).alias("excess")), _R.format(said(f"r - {RF}"), "excess"))
rows("r09_return_centered", lambda d: d.select("date", "asset", shown(r - F.avg(r).over(Window.partitionBy("asset"))).alias("centered")), f"SELECT date, asset, {said('r - mr')} AS centered FROM rc")
rows(
    "r10_return_relative",
    lambda d: d.select("date", "asset", shown(P.wealth(r) / P.wealth(b)).alias("relative")),
    f"SELECT date, asset, {said('exp(sum(ln(1 + r)) OVER o) / exp(sum(ln(1 + b)) OVER o)')} AS relative FROM rb WINDOW o AS (PARTITION BY asset ORDER BY date)",
)
measure("r11_return_annualized", geometric=(lambda: A.annualized(r, S), _year("r")))
measure("r12_return_annualized_unit", geometric=(lambda: A.annualized(r, 1), "exp(avg(ln(1 + r))) - 1"))
measure("r13_return_annualized_arithmetic", arithmetic=(lambda: A.annualized(r, S, "arithmetic"), f"avg(r) * {S}"))
measure("r14_return_annualized_excess", geometric=(lambda: A.annualized_excess(r, b, S), f"exp({S} * avg(ln(1 + r - b))) - 1"), arithmetic=(lambda: A.annualized_excess(r, b, S, "arithmetic"), f"avg(r - b) * {S}"))
measure("r15_scalar_annualized", discrete=(lambda: A.scaled(F.avg(r), S, "discrete"), f"pow(1 + avg(r), {S}) - 1"), log=(lambda: A.scaled(F.avg(r), S, "log"), f"avg(r) * {S}"), std=(lambda: A.scaled(F.stddev_samp(r), S, "std"), f"{_sd} * sqrt({S})"))
measure("r16_geometric_mean", geometric=(lambda: A.geometric_mean(r), "exp(avg(ln(1 + r))) - 1"))
measure("r17_active_premium", geometric=(lambda: A.active_premium(r, b, S), f"{_year('r')} - {_year('b')}"), arithmetic=(lambda: A.active_premium(r, b, S, "arithmetic"), f"(avg(r) - avg(b)) * {S}"))

# --- risk --------------------------------------------------------------------
measure("k01_stddev_annualized", sd=(lambda: A.deviation(r, S), f"{_sd} * sqrt({S})"))
rows(
    "k02_mean_absolute_deviation",
    lambda d: d.withColumn("mu", F.avg(r).over(Window.partitionBy("asset"))).groupBy("asset").agg(shown(F.avg(F.abs(r - F.col("mu")))).alias("mad")),
    f"SELECT asset, {said('avg(abs(r - mr))')} AS mad FROM rc GROUP BY asset",
)
measure("k03_downside_deviation", dd=(lambda: A.downside_deviation(r, MAR), f"sqrt({_dn('r', 2)})"))
measure("k04_downside_potential", dp=(lambda: A.downside_potential(r, MAR), _dn("r", 1)))
measure("k05_downside_frequency", freq=(lambda: A.downside_frequency(r, MAR), f"avg(CASE WHEN r < {MAR} THEN 1.0 ELSE 0.0 END)"))
measure("k06_upside", risk=(lambda: A.upside_risk(r, MAR), f"sqrt({_up('r', 2)})"), frequency=(lambda: A.upside_frequency(r, MAR), f"avg(CASE WHEN r > {MAR} THEN 1.0 ELSE 0.0 END)"), potential=(lambda: A.upside_potential(r, MAR), _up("r", 1)))
measure("k07_upside_potential_ratio", ratio=(lambda: A.upside_potential_ratio(r, MAR), f"{_up('r', 1)} / sqrt({_dn('r', 2)})"))
measure("k08_volatility_skewness", volatility=(lambda: A.volatility_skewness(r, MAR), f"{_up('r', 2)} / {_dn('r', 2)}"), variability=(lambda: A.variability_skewness(r, MAR), f"sqrt({_up('r', 2)}) / sqrt({_dn('r', 2)})"))
measure("k09_lower_partial_moment", **{f"lpm{k}": (lambda k=k: M.lower_moment(r, F.lit(MAR), k) * 1000, f"{_dn('r', k)} * 1000") for k in (1, 2, 3, 4)})
measure("k10_tracking_error", te=(lambda: A.tracking_error(r, b, S), f"stddev_samp(r - b) * sqrt({S})"))
measure("k11_risk_split", systematic=(lambda: A.systematic_risk(r, b, RF, S), _sys), specific=(lambda: A.specific_risk(r, b, RF, S), _spec), total=(lambda: A.total_risk(r, b, RF, S), f"sqrt(pow({_sys}, 2) + pow({_spec}, 2))"))
measure("k13_skewness_kurtosis_ratio", ratio=(lambda: A.skewness_kurtosis_ratio(r), f"{_skew} / {_kurt}"))
measure("k14_centered_moments", m2=(lambda: M.m2(r) * 1e3, f"{_c(2, 0)} * 1e3"), m3=(lambda: M.m3(r) * 1e3, f"{_c(3, 0)} * 1e3"), m4=(lambda: M.m4(r) * 1e3, f"{_c(4, 0)} * 1e3"), coskewness=(lambda: M.m12(r, b) * 1e3, f"{_c(1, 2)} * 1e3"), cokurtosis=(lambda: M.m13(r, b) * 1e3, f"{_c(1, 3)} * 1e3"))
rows(
    "k15_cokurtosis_matrix",
    lambda d: P.pairs(d).groupBy("a1", "a2").agg(shown(M.safe(M.m22(F.col("r1"), F.col("r2")), M.m2(F.col("r1")) * M.m2(F.col("r2")))).alias("cokurtosis")),
    f"SELECT x.asset AS a1, y.asset AS a2, {said('avg(pow(x.r - x.mr, 2) * pow(y.r - y.mr, 2)) / (avg(pow(x.r - x.mr, 2)) * avg(pow(y.r - y.mr, 2)))')} AS cokurtosis FROM rc x JOIN rc y USING (date) GROUP BY 1, 2",
)
_co = {"beta_covariance": f"{_c(1, 1)} / {_c(0, 2)}", "beta_coskewness": f"{_c(1, 2)} / {_c(0, 3)}", "beta_cokurtosis": f"{_c(1, 3)} / {_c(0, 4)}"}
measure("k16_beta_co_moments", **{k: (lambda k=k: A.co_moments(r, b)[k], q) for k, q in _co.items()})

# --- regression --------------------------------------------------------------
measure("b01_capm_beta", beta=(lambda: A.beta(r, b, RF), _beta))
measure("b02_bull_bear_beta", bull=(lambda: A.bull_beta(r, b, RF), f"regr_slope({_y}, {_x}) FILTER (WHERE b > {RF})"), bear=(lambda: A.bear_beta(r, b, RF), f"regr_slope({_y}, {_x}) FILTER (WHERE b < {RF})"))
measure("b03_capm_alpha", alpha=(lambda: A.alpha(r, b, RF), _alpha))
measure("b04_capm_epsilon", epsilon=(lambda: A.epsilon(r, b, RF, S), f"{_year('r')} - {_rfy} - {_alpha} * {S} - {_beta} * ({_year('b')} - {_rfy})"))
rows(
    "b04_capm_residuals",
    lambda d: d.withColumn("a", A.alpha(r, b, RF).over(Window.partitionBy("asset"))).withColumn("s", A.beta(r, b, RF).over(Window.partitionBy("asset"))).select("date", "asset", shown(r - RF - F.col("a") - F.col("s") * (b - RF)).alias("residual")),
    f"SELECT date, asset, {said(f'r - {RF} - {_alpha} OVER o - {_beta} OVER o * (b - {RF})')} AS residual FROM rb WINDOW o AS (PARTITION BY asset)",
)
measure("b05_fama_beta", beta=(lambda: A.fama_beta(r, b), f"{_sdp} / stddev_pop(b)"))
_jensen = f"({_year('r')} - {_rfy} - {_beta} * ({_year('b')} - {_rfy}))"
measure("b06_net_selectivity", selectivity=(lambda: A.net_selectivity(r, b, RF, S), f"{_jensen} - ({_sdp} / stddev_pop(b) - {_beta}) * ({_year('b')} - {_rfy})"))


def _timing(x: str, z: str) -> dict[str, str]:
    y, det = _y, f"(var_pop({x}) * var_pop({z}) - pow(covar_pop({x}, {z}), 2))"
    p = f"((var_pop({z}) * covar_pop({x}, {y}) - covar_pop({x}, {z}) * covar_pop({z}, {y})) / {det})"
    q = f"((var_pop({x}) * covar_pop({z}, {y}) - covar_pop({x}, {z}) * covar_pop({x}, {y})) / {det})"
    return {"alpha": f"avg({y}) - {p} * avg({x}) - {q} * avg({z})", "beta": p, "gamma": q}


for _m, _z in (("TM", f"({_x} * {_x})"), ("HM", f"greatest({_x}, 0)")):
    measure(f"b06_market_timing_{_m.lower()}", **{k: (lambda k=k, m=_m: A.market_timing(r, b, RF, m)[k], q) for k, q in _timing(_x, _z).items()})

# --- ratios --------------------------------------------------------------------
measure("q01_sharpe", sharpe=(lambda: A.sharpe(r, RF), f"avg({_y}) / stddev_samp({_y})"))
measure("q02_sharpe_annualized", arithmetic=(lambda: A.sharpe(r, RF, S), _sharpe), geometric=(lambda: A.sharpe_geometric(r, RF, S), f"(exp({S} * avg(ln(1 + {_y}))) - 1) / ({_sd} * sqrt({S}))"))
measure("q03_adjusted_sharpe", ratio=(lambda: A.adjusted_sharpe(r, RF, S), f"{_sharpe} * (1 + {_skew} / 6 * {_sharpe} - ({_kurt} - 3) / 24 * {_sharpe} * {_sharpe})"))
measure("q04_information_ratio", ratio=(lambda: A.information_ratio(r, b, S), f"avg(r - b) / stddev_samp(r - b) * sqrt({S})"))
measure("q05_appraisal_ratio", ratio=(lambda: A.appraisal_ratio(r, b, RF, S), f"{_alpha} * {S} / {_spec}"))
measure("q06_treynor_ratio", ratio=(lambda: A.treynor(r, b, RF, S), f"avg({_y}) * {S} / {_beta}"), modified=(lambda: A.treynor(r, b, RF, S, True), f"avg({_y}) * {S} / {_sys}"))
measure("q07_sortino", ratio=(lambda: A.sortino(r, MAR), f"avg(r - {MAR}) / sqrt({_dn('r', 2)})"))
measure("q08_kappa", **{f"kappa{k}": (lambda k=k: A.kappa(r, MAR, k), f"avg(r - {MAR}) / pow({_dn('r', k)}, 1.0 / {k})") for k in (1, 2, 3)})
measure("q09_omega", omega=(lambda: A.omega(r, MAR), f"{_up('r', 1)} / {_dn('r', 1)}"))
measure("q10_omega_sharpe", ratio=(lambda: A.omega_sharpe(r, MAR), f"avg(r - {MAR}) / {_dn('r', 1)}"))
measure("q11_omega_excess", excess=(lambda: A.omega_excess(r, b, MAR, S), f"{_year('r')} - 3 * sqrt({_dn('r', 2)}) * sqrt({_dn('b', 2)}) * {S}"))
_m2 = f"({_sharpe} * stddev_samp(b) * sqrt({S}) + {RF} * {S})"
measure("q12_m_squared", m2=(lambda: A.m_squared(r, b, RF, S), _m2))
measure("q13_m_squared_excess", arithmetic=(lambda: A.m_squared_excess(r, b, RF, S), f"{_m2} - avg(b) * {S}"), geometric=(lambda: A.m_squared_excess(r, b, RF, S, "geometric"), f"(1 + {_m2}) / (1 + avg(b) * {S}) - 1"))
measure("q14_m_squared_sortino", m2=(lambda: A.m_squared_sortino(r, b, MAR, S), f"{_year('r')} + avg(r - {MAR}) / sqrt({_dn('r', 2)}) * sqrt({S}) * (sqrt({_dn('b', 2)}) - sqrt({_dn('r', 2)})) * sqrt({S})"))
measure("q15_kelly", kelly=(lambda: A.kelly(r, RF), f"avg({_y}) / var_samp(r) * 0.5"), full=(lambda: A.kelly(r, RF, 1.0), f"avg({_y}) / var_samp(r)"))
_cap = lambda o: f"avg(r) FILTER (WHERE b {o} 0) / avg(b) FILTER (WHERE b {o} 0)"
measure("q17_capture_ratios", up=(lambda: A.up_capture(r, b), _cap(">")), down=(lambda: A.down_capture(r, b), _cap("<")))
_n = lambda c, d: f"count(*) FILTER (WHERE {c}) / CAST(count(*) FILTER (WHERE {d}) AS DOUBLE)"
_ud = {"up_number": _n("r > 0 AND b > 0", "b > 0"), "down_number": _n("r < 0 AND b < 0", "b < 0"), "up_percent": _n("r > b AND b > 0", "b > 0"), "down_percent": _n("r > b AND b < 0", "b < 0"), "up_capture": _cap(">"), "down_capture": _cap("<")}
measure("q18_up_down_ratios", **{k: (lambda k=k: A.up_down(r, b)[k], q) for k, q in _ud.items()})
measure(
    "q19_gain_loss_ratios",
    bernardo_ledoit=(lambda: A.bernardo_ledoit(r), "sum(greatest(r, 0)) / sum(greatest(-r, 0))"),
    d_ratio=(lambda: A.d_ratio(r), "(count(*) FILTER (WHERE r < 0) * sum(greatest(-r, 0))) / (count(*) FILTER (WHERE r > 0) * sum(greatest(r, 0)))"),
    prospect=(lambda: A.prospect_ratio(r, MAR), f"(avg(greatest(r, 0) + 2.25 * least(r, 0)) - {MAR}) / sqrt({_dn('r', 2)})"),
)

# --- drawdowns -----------------------------------------------------------------
_EPISODE = 'asset, CAST(episode AS INT) AS episode, begin, trough, "end", ' + said("depth") + " AS depth, CAST(length AS BIGINT) AS length, CAST(to_trough AS BIGINT) AS to_trough, CAST(recovery AS BIGINT) AS recovery, recovered"


def _episodes(d: DataFrame) -> DataFrame:
    return P.episodes(d).withColumn("depth", shown(F.col("depth")))


rows("d01_drawdowns", lambda d: P.drawdowns(d).select("date", "asset", shown(F.col("dd")).alias("dd")), f"SELECT date, asset, {said('dd')} AS dd FROM dd")
rows("d02_max_drawdown", lambda d: P.drawdowns(d).groupBy("asset").agg(shown(F.min("dd")).alias("max_drawdown")), f"SELECT asset, {said('min(dd)')} AS max_drawdown FROM dd GROUP BY asset")
rows("d03_find_drawdowns", _episodes, f"SELECT {_EPISODE} FROM ep")
rows(
    "d04_sort_drawdowns",
    lambda d: P.episodes(d).withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy("depth", "begin"))).select("asset", "rank", "begin", shown(F.col("depth")).alias("depth")),
    f"SELECT asset, CAST(row_number() OVER (PARTITION BY asset ORDER BY depth, begin) AS INT) AS rank, begin, {said('depth')} AS depth FROM ep",
)
rows(
    "d05_average_drawdown",
    lambda d: P.episodes(d).groupBy("asset").agg(*[shown(F.avg(c)).alias(f"average_{c}") for c in ("depth", "length", "recovery")]),
    f"SELECT asset, {', '.join(f'{said(f"avg({c})")} AS average_{c}' for c in ('depth', 'length', 'recovery'))} FROM ep GROUP BY asset",
)
rows(
    "d06_drawdown_deviation",
    lambda d: P.episodes(d).groupBy("asset").agg(F.sum(F.col("depth") * F.col("depth")).alias("s")).join(d.groupBy("asset").agg(F.count("r").alias("n")), "asset").select("asset", shown(F.sqrt(F.col("s") / F.col("n"))).alias("deviation")),
    f"SELECT asset, {said('sqrt(s / n)')} AS deviation FROM (SELECT asset, sum(depth * depth) AS s FROM ep GROUP BY asset) JOIN (SELECT asset, count(r) AS n FROM rb GROUP BY asset) USING (asset)",
)
rows("d07_pain_index", lambda d: P.drawdowns(d).groupBy("asset").agg(shown(F.avg(F.abs("dd"))).alias("pain")), f"SELECT asset, {said('avg(abs(dd))')} AS pain FROM dd GROUP BY asset")
rows("d08_ulcer_index", lambda d: P.drawdowns(d).groupBy("asset").agg(shown(F.sqrt(F.avg(F.col("dd") * F.col("dd")))).alias("ulcer")), f"SELECT asset, {said('sqrt(avg(dd * dd))')} AS ulcer FROM dd GROUP BY asset")
rows(
    "d09_conditional_drawdown",
    lambda d: P.episodes(d).withColumn("q", F.percent_rank().over(Window.partitionBy("asset").orderBy("depth", "begin"))).where("q <= 0.25").groupBy("asset").agg(shown(F.avg("depth")).alias("cdd")),
    f"SELECT asset, {said('avg(depth)')} AS cdd FROM (SELECT *, percent_rank() OVER (PARTITION BY asset ORDER BY depth, begin) AS q FROM ep) WHERE q <= 0.25 GROUP BY asset",
)


def _drawdown_ratios(d: DataFrame) -> DataFrame:
    dd = P.drawdowns(d).groupBy("asset").agg(A.annualized(r, S).alias("y"), F.min("dd").alias("worst"), F.avg(F.abs("dd")).alias("pain"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"))
    burke = P.episodes(d).groupBy("asset").agg(F.sqrt(F.sum(F.col("depth") * F.col("depth"))).alias("root"))
    over = lambda den: shown(M.safe(F.col("y") - A.annualized_rf(RF, S), den))
    return dd.join(burke, "asset").select("asset", shown(M.safe(F.col("y"), F.abs("worst"))).alias("calmar"), shown(M.safe(F.col("y"), F.abs("worst") + 0.1)).alias("sterling"), over(F.col("root")).alias("burke"), over(F.col("ulcer")).alias("martin"), over(F.col("pain")).alias("pain_ratio"))


rows(
    "q16_drawdown_ratios",
    _drawdown_ratios,
    f"SELECT asset, {said('y / abs(worst)')} AS calmar, {said('y / (abs(worst) + 0.1)')} AS sterling, {said(f'(y - {_rfy}) / root')} AS burke, {said(f'(y - {_rfy}) / ulcer')} AS martin, {said(f'(y - {_rfy}) / pain')} AS pain_ratio FROM (SELECT asset, {_year('r')} AS y, min(dd) AS worst, avg(abs(dd)) AS pain, sqrt(avg(dd * dd)) AS ulcer FROM dd GROUP BY asset) JOIN (SELECT asset, sqrt(sum(depth * depth)) AS root FROM ep GROUP BY asset) USING (asset)",
)

# --- tables --------------------------------------------------------------------
_q = lambda p: (lambda: F.expr(f"percentile(r, {p})"), f"quantile_cont(r, {p})")
measure(
    "e01_table_stats",
    n=(lambda: F.count(r), "count(r)"), nas=(lambda: F.sum(r.isNull().cast("long")), "count(*) - count(r)"), minimum=(lambda: F.min(r), "min(r)"), q1=_q(0.25), median=_q(0.5), mean=(lambda: F.avg(r), "avg(r)"),
    geometric=(lambda: A.geometric_mean(r), "exp(avg(ln(1 + r))) - 1"), q3=_q(0.75), maximum=(lambda: F.max(r), "max(r)"), se_mean=(lambda: F.stddev_samp(r) / F.sqrt(F.count(r)), f"{_sd} / sqrt(count(r))"),
    variance=(lambda: F.var_samp(r), "var_samp(r)"), stdev=(lambda: F.stddev_samp(r), _sd), skewness=(lambda: M.skewness(r), _skew), kurtosis=(lambda: M.kurtosis(r), f"{_kurt} - 3"),
)
measure("e02_table_distributions", mean=(lambda: F.avg(r), "avg(r)"), sd=(lambda: F.stddev_samp(r), _sd), scaled_sd=(lambda: A.deviation(r, S), f"{_sd} * sqrt({S})"), skew=(lambda: M.skewness(r, "sample"), "skewness(r)"), kurt=(lambda: M.kurtosis(r, "sample"), "kurtosis(r)"), least=(lambda: F.min(r), "min(r)"), most=(lambda: F.max(r), "max(r)"), median=_q(0.5))
measure(
    "e03_table_higher_moments",
    mean=(lambda: F.avg(r), "avg(r)"), sd=(lambda: F.stddev_samp(r), _sd), skew=(lambda: M.skewness(r), _skew), kurt=(lambda: M.kurtosis(r, excess=False), _kurt),
    coskewness=(lambda: A.co_moments(r, b)["coskewness"], f"{_c(1, 2)} / ({_sdp} * {_c(0, 2)})"), cokurtosis=(lambda: A.co_moments(r, b)["cokurtosis"], f"{_c(1, 3)} / ({_sdp} * pow({_c(0, 2)}, 1.5))"),
)
measure("e04_table_annualized_returns", annual_return=(lambda: A.annualized(r, S), _year("r")), annual_sd=(lambda: A.deviation(r, S), f"{_sd} * sqrt({S})"), annual_sharpe=(lambda: A.sharpe(r, RF, S), _sharpe))
_months = list(range(1, 13))
rows(
    "e05_table_calendar_returns",
    lambda d: d.groupBy("asset", F.year("date").cast("int").alias("year")).agg(*[shown(F.max(F.when(F.month("date") == m, r))).alias(f"m{m:02d}") for m in _months], shown(A.accumulated(r)).alias("total")),
    f"SELECT asset, CAST(year(date) AS INT) AS year, {', '.join(f'{said(f"max(CASE WHEN month(date) = {m} THEN r END)")} AS m{m:02d}' for m in _months)}, {said('exp(sum(ln(1 + r))) - 1')} AS total FROM rb GROUP BY asset, year(date)",
)
rows(
    "e06_table_drawdowns",
    lambda d: P.episodes(d).withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy("depth", "begin"))).where("rank <= 5").select("asset", "rank", "begin", "trough", "end", F.round("depth", 4).alias("depth"), "length", "to_trough", "recovery"),
    'SELECT asset, CAST(rank AS INT) AS rank, begin, trough, "end", round(depth, 4) AS depth, CAST(length AS BIGINT) AS length, CAST(to_trough AS BIGINT) AS to_trough, CAST(recovery AS BIGINT) AS recovery FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY depth, begin) AS rank FROM ep) WHERE rank <= 5',
)
_lags = range(1, 7)


def _autocorrelation(d: DataFrame) -> DataFrame:
    lagged = d.select("asset", "r", *[F.lag("r", k).over(P.by_time()).alias(f"l{k}") for k in _lags])
    rho = lagged.groupBy("asset").agg(F.count("r").alias("n"), *[F.corr("r", f"l{k}").alias(f"rho{k}") for k in _lags])
    q = sum((F.col(f"rho{k}") * F.col(f"rho{k}") / (F.col("n") - k) for k in _lags), F.lit(0.0))
    return rho.select("asset", *[shown(F.col(f"rho{k}")).alias(f"rho{k}") for k in _lags], shown(F.col("n") * (F.col("n") + 2) * q).alias("q6"))


rows(
    "e07_table_autocorrelation",
    _autocorrelation,
    f"SELECT asset, {', '.join(f'{said(f"rho{k}")} AS rho{k}' for k in _lags)}, {said('n * (n + 2) * (' + ' + '.join(f'rho{k} * rho{k} / (n - {k})' for k in _lags) + ')')} AS q6 FROM (SELECT asset, count(r) AS n, {', '.join(f'corr(r, l{k}) AS rho{k}' for k in _lags)} FROM (SELECT asset, r, {', '.join(f'lag(r, {k}) OVER (PARTITION BY asset ORDER BY date) AS l{k}' for k in _lags)} FROM rb) GROUP BY asset)",
)
measure("e08_table_capm", alpha=(lambda: A.alpha(r, b, RF), _alpha), beta=(lambda: A.beta(r, b, RF), _beta), r2=(lambda: F.regr_r2(r - RF, b - RF), f"regr_r2({_y}, {_x})"), te=(lambda: A.tracking_error(r, b, S), f"stddev_samp(r - b) * sqrt({S})"), ir=(lambda: A.information_ratio(r, b, S), f"avg(r - b) / stddev_samp(r - b) * sqrt({S})"), treynor=(lambda: A.treynor(r, b, RF, S), f"avg({_y}) * {S} / {_beta}"))
rows(
    "e09_table_correlation",
    lambda d: P.pairs(d).groupBy("a1", "a2").agg(shown(F.corr("r1", "r2")).alias("corr"), F.count("*").alias("n")),
    f"SELECT x.asset AS a1, y.asset AS a2, {said('corr(x.r, y.r)')} AS corr, count(*) AS n FROM rb x JOIN rb y USING (date) GROUP BY 1, 2",
)
rows(
    "e10_table_variability",
    lambda d: d.withColumn("mu", F.avg(r).over(Window.partitionBy("asset"))).groupBy("asset").agg(shown(F.avg(F.abs(r - F.col("mu")))).alias("mad"), shown(F.stddev_samp(r)).alias("sd"), shown(A.deviation(r, S)).alias("annual_sd")),
    f"SELECT asset, {said('avg(abs(r - mr))')} AS mad, {said(_sd)} AS sd, {said(f'{_sd} * sqrt({S})')} AS annual_sd FROM rc GROUP BY asset",
)
measure("e11_table_information_ratio", active=(lambda: A.active_premium(r, b, S, "arithmetic"), f"(avg(r) - avg(b)) * {S}"), te=(lambda: A.tracking_error(r, b, S), f"stddev_samp(r - b) * sqrt({S})"), ir=(lambda: A.information_ratio(r, b, S), f"avg(r - b) / stddev_samp(r - b) * sqrt({S})"))
measure("e11_table_specific_risk", specific=(lambda: A.specific_risk(r, b, RF, S), _spec), systematic=(lambda: A.systematic_risk(r, b, RF, S), _sys), total=(lambda: A.total_risk(r, b, RF, S), f"sqrt(pow({_sys}, 2) + pow({_spec}, 2))"))
rows(
    "e11_table_downside",
    lambda d: d.groupBy("asset").agg(*[shown(c).alias(n) for n, c in {"semi": F.sqrt(M.lower_moment(r, F.lit(0.0), 2)), "downside": A.downside_deviation(r, MAR), "omega": A.omega(r, MAR), "sortino": A.sortino(r, MAR), "upside_potential_ratio": A.upside_potential_ratio(r, MAR)}.items()]),
    f"SELECT asset, {said(f'sqrt({_dn("r", 2, 0)})')} AS semi, {said(f'sqrt({_dn("r", 2)})')} AS downside, {said(f'{_up("r", 1)} / {_dn("r", 1)}')} AS omega, {said(f'avg(r - {MAR}) / sqrt({_dn("r", 2)})')} AS sortino, {said(f'{_up("r", 1)} / sqrt({_dn("r", 2)})')} AS upside_potential_ratio FROM rb GROUP BY asset",
)


# --- Hurst index: rescaled range over the whole series and its halves ------------
def _rescaled(d: DataFrame) -> DataFrame:
    """(asset, n, rs): range of the cumulated deviations over the deviation, for
    the whole series and the mean over its two halves."""
    at = d.withColumn("at", F.row_number().over(P.by_time())).withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    cut = F.explode(F.array(F.struct(F.lit(1).alias("parts"), F.lit(0).alias("part")), F.struct(F.lit(2).alias("parts"), F.when(F.col("at") <= F.expr("n div 2"), 0).otherwise(1).alias("part"))))
    rows_ = at.withColumn("c", cut).select("asset", "at", "r", "c.*")
    w = Window.partitionBy("asset", "parts", "part")
    dev = rows_.withColumn("dev", F.col("r") - F.avg("r").over(w))
    path = dev.withColumn("z", F.sum("dev").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = path.groupBy("asset", "parts", "part").agg(F.count("*").alias("m"), M.safe(F.max("z") - F.min("z"), F.stddev_pop("r")).alias("rs"))
    return each.groupBy("asset", "parts").agg(F.avg("m").alias("m"), F.avg("rs").alias("rs"))


rows(
    "k12_hurst_index",
    lambda d: _rescaled(d).groupBy("asset").agg(shown(F.regr_slope(F.log("rs"), F.log("m"))).alias("hurst")),
    f"SELECT asset, {said('regr_slope(ln(rs), ln(m))')} AS hurst FROM (SELECT asset, parts, avg(m) AS m, avg(rs) AS rs FROM (SELECT asset, parts, part, count(*) AS m, (max(z) - min(z)) / any_value(s) AS rs FROM (SELECT asset, parts, part, sum(r - mu) OVER (PARTITION BY asset, parts, part ORDER BY at_) AS z, s FROM (SELECT *, avg(r) OVER (PARTITION BY asset, parts, part) AS mu, stddev_pop(r) OVER (PARTITION BY asset, parts, part) AS s FROM (SELECT asset, r, at_, parts, CASE WHEN parts = 1 OR at_ <= n // 2 THEN 0 ELSE 1 END AS part FROM (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS at_, count(*) OVER (PARTITION BY asset) AS n FROM rb), unnest([1, 2]) AS u(parts)))) GROUP BY asset, parts, part) GROUP BY asset, parts) GROUP BY asset",
)


# --- portfolio Kelly: inverse covariance times mean excess, for two assets ---------
def _kelly_pair(d: DataFrame) -> DataFrame:
    """Weights of A and R that maximise growth, normalised to one: a closed form over sums."""
    x = F.max(F.when(F.col("asset") == "A", r))
    y = F.max(F.when(F.col("asset") == "R", r))
    both = d.groupBy("date").agg(x.alias("x"), y.alias("y")).dropna()
    m = both.agg(F.avg(F.col("x") - RF).alias("mx"), F.avg(F.col("y") - RF).alias("my"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    a, c = F.col("yy") * F.col("mx") - F.col("xy") * F.col("my"), F.col("xx") * F.col("my") - F.col("xy") * F.col("mx")
    return m.select(F.round(M.safe(a, a + c), 4).alias("a"), F.round(M.safe(c, a + c), 4).alias("r"))


rows(
    "q15_kelly_portfolio",
    _kelly_pair,
    f"SELECT round((yy * mx - xy * my) / ((yy * mx - xy * my) + (xx * my - xy * mx)), 4) AS a, round((xx * my - xy * mx) / ((yy * mx - xy * my) + (xx * my - xy * mx)), 4) AS r FROM (SELECT avg(x.r - {RF}) AS mx, avg(y.r - {RF}) AS my, var_samp(x.r) AS xx, var_samp(y.r) AS yy, covar_samp(x.r, y.r) AS xy FROM rb x JOIN rb y ON x.date = y.date AND x.asset = 'A' AND y.asset = 'R')",
)
