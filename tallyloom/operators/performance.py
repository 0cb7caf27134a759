"""Return, risk, regression and ratio measures as aggregate Columns.

r: period return of an asset; b: of the benchmark; rf, mar: periodic risk-free
and target return (Columns or numbers); scale: periods in a year.  All are
meant for one grouped aggregation over a long (date, asset, r, b) panel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.moments import kurtosis, lower_moment, m2, m3, m4, m11, m12, m13, safe, skewness, upper_moment

Number = float | Column


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# returns


def log_growth(r: Column) -> Column:
    return F.log(1 + r)


def accumulated(r: Column) -> Column:
    return F.exp(F.sum(log_growth(r))) - 1


def annualized(r: Column, scale: float, method: str = "geometric") -> Column:
    if method == "geometric":
        return F.exp(F.lit(float(scale)) * F.avg(log_growth(r))) - 1
    return F.avg(r) * scale


def geometric_mean(r: Column) -> Column:
    return annualized(r, 1)


def annualized_excess(r: Column, b: Column, scale: float, method: str = "geometric") -> Column:
    return annualized(r - b, scale, method)


def scaled(v: Column, scale: float, kind: str) -> Column:
    """Annualise a scalar: a discrete return, a log return or a standard deviation."""
    return {"discrete": F.pow(1 + v, F.lit(float(scale))) - 1, "log": v * scale, "std": v * float(scale) ** 0.5}[kind]


def annualized_rf(rf: Number, scale: float) -> Column:
    return (1 + _c(rf)) ** scale - 1


def active_premium(r: Column, b: Column, scale: float, method: str = "geometric") -> Column:
    return annualized(r, scale, method) - annualized(b, scale, method)


# risk


def deviation(r: Column, scale: float = 1.0, vardef: str = "sample") -> Column:
    return (F.stddev_samp(r) if vardef == "sample" else F.stddev_pop(r)) * float(scale) ** 0.5


def downside_deviation(r: Column, mar: Number) -> Column:
    return F.sqrt(lower_moment(r, _c(mar), 2))


def upside_risk(r: Column, mar: Number) -> Column:
    return F.sqrt(upper_moment(r, _c(mar), 2))


def downside_potential(r: Column, mar: Number) -> Column:
    return lower_moment(r, _c(mar), 1)


def upside_potential(r: Column, mar: Number) -> Column:
    return upper_moment(r, _c(mar), 1)


def downside_frequency(r: Column, mar: Number) -> Column:
    return F.avg((r < _c(mar)).cast("double"))


def upside_frequency(r: Column, mar: Number) -> Column:
    return F.avg((r > _c(mar)).cast("double"))


def upside_potential_ratio(r: Column, mar: Number) -> Column:
    return safe(upside_potential(r, mar), downside_deviation(r, mar))


def volatility_skewness(r: Column, mar: Number) -> Column:
    return safe(upper_moment(r, _c(mar), 2), lower_moment(r, _c(mar), 2))


def variability_skewness(r: Column, mar: Number) -> Column:
    return safe(upside_risk(r, mar), downside_deviation(r, mar))


def tracking_error(r: Column, b: Column, scale: float) -> Column:
    return deviation(r - b, scale)


def skewness_kurtosis_ratio(r: Column) -> Column:
    return safe(skewness(r), kurtosis(r, excess=False))


# regression on the benchmark's excess return


def beta(r: Column, b: Column, rf: Number = 0.0) -> Column:
    return F.regr_slope(r - _c(rf), b - _c(rf))


def alpha(r: Column, b: Column, rf: Number = 0.0) -> Column:
    return F.regr_intercept(r - _c(rf), b - _c(rf))


def bull_beta(r: Column, b: Column, rf: Number = 0.0) -> Column:
    up = b > _c(rf)
    return F.regr_slope(F.when(up, r - _c(rf)), F.when(up, b - _c(rf)))


def bear_beta(r: Column, b: Column, rf: Number = 0.0) -> Column:
    down = b < _c(rf)
    return F.regr_slope(F.when(down, r - _c(rf)), F.when(down, b - _c(rf)))


def epsilon(r: Column, b: Column, rf: Number, scale: float) -> Column:
    """Annualised return that neither alpha nor beta explains."""
    rf_year = (1 + _c(rf)) ** scale - 1
    return annualized(r, scale) - rf_year - alpha(r, b, rf) * scale - beta(r, b, rf) * (annualized(b, scale) - rf_year)


def fama_beta(r: Column, b: Column) -> Column:
    return safe(F.stddev_pop(r), F.stddev_pop(b))


def residual_variance(r: Column, b: Column, rf: Number = 0.0) -> Column:
    """Population variance of the regression's residuals."""
    x, y = b - _c(rf), r - _c(rf)
    return F.greatest(m2(y) - safe(m11(y, x) * m11(y, x), m2(x)), F.lit(0.0))


def systematic_risk(r: Column, b: Column, rf: Number, scale: float) -> Column:
    return beta(r, b, rf) * F.stddev_pop(b) * float(scale) ** 0.5


def specific_risk(r: Column, b: Column, rf: Number, scale: float) -> Column:
    return F.sqrt(residual_variance(r, b, rf)) * float(scale) ** 0.5


def total_risk(r: Column, b: Column, rf: Number, scale: float) -> Column:
    s, t = systematic_risk(r, b, rf, scale), specific_risk(r, b, rf, scale)
    return F.sqrt(s * s + t * t)


def net_selectivity(r: Column, b: Column, rf: Number, scale: float) -> Column:
    """Jensen's alpha less the return that full diversification would ask for."""
    rf_year = (1 + _c(rf)) ** scale - 1
    bench = annualized(b, scale) - rf_year
    jensen = annualized(r, scale) - rf_year - beta(r, b, rf) * bench
    return jensen - (fama_beta(r, b) - beta(r, b, rf)) * bench


def _two_regressors(y: Column, x: Column, z: Column) -> tuple[Column, Column, Column]:
    """Intercept and both slopes of the regression of y on x and z."""
    xx, zz, xz, xy, zy = m2(x), m2(z), m11(x, z), m11(x, y), m11(z, y)
    det = xx * zz - xz * xz
    p, q = safe(zz * xy - xz * zy, det), safe(xx * zy - xz * xy, det)
    return F.avg(y) - p * F.avg(x) - q * F.avg(z), p, q


def market_timing(r: Column, b: Column, rf: Number = 0.0, method: str = "TM") -> Column:
    """(alpha, beta, gamma): gamma on the squared (TM) or positive (HM) excess return of the benchmark."""
    x, y = b - _c(rf), r - _c(rf)
    a, p, q = _two_regressors(y, x, x * x if method == "TM" else F.greatest(x, F.lit(0.0)))
    return F.struct(a.alias("alpha"), p.alias("beta"), q.alias("gamma"))


# ratios


def sharpe(r: Column, rf: Number, scale: float = 1.0) -> Column:
    return safe(F.avg(r - _c(rf)), F.stddev_samp(r - _c(rf))) * float(scale) ** 0.5


def sharpe_geometric(r: Column, rf: Number, scale: float) -> Column:
    return safe(annualized(r - _c(rf), scale), deviation(r, scale))


def adjusted_sharpe(r: Column, rf: Number, scale: float) -> Column:
    s = sharpe(r, rf, scale)
    return s * (1 + skewness(r) / 6 * s - kurtosis(r) / 24 * s * s)


def information_ratio(r: Column, b: Column, scale: float) -> Column:
    return safe(F.avg(r - b), F.stddev_samp(r - b)) * float(scale) ** 0.5


def appraisal_ratio(r: Column, b: Column, rf: Number, scale: float) -> Column:
    return safe(alpha(r, b, rf) * scale, specific_risk(r, b, rf, scale))


def treynor(r: Column, b: Column, rf: Number, scale: float, modified: bool = False) -> Column:
    return safe(F.avg(r - _c(rf)) * scale, systematic_risk(r, b, rf, scale) if modified else beta(r, b, rf))


def sortino(r: Column, mar: Number) -> Column:
    return safe(F.avg(r - _c(mar)), downside_deviation(r, mar))


def kappa(r: Column, mar: Number, order: float) -> Column:
    return safe(F.avg(r - _c(mar)), F.pow(lower_moment(r, _c(mar), order), F.lit(1.0 / order)))


def omega(r: Column, level: Number) -> Column:
    return safe(upside_potential(r, level), downside_potential(r, level))


def omega_sharpe(r: Column, mar: Number) -> Column:
    return safe(F.avg(r - _c(mar)), downside_potential(r, mar))


def omega_excess(r: Column, b: Column, mar: Number, scale: float) -> Column:
    root = float(scale) ** 0.5
    return annualized(r, scale) - 3 * downside_deviation(r, mar) * root * downside_deviation(b, mar) * root


def m_squared(r: Column, b: Column, rf: Number, scale: float) -> Column:
    return sharpe(r, rf, scale) * deviation(b, scale) + _c(rf) * scale


def m_squared_excess(r: Column, b: Column, rf: Number, scale: float, method: str = "arithmetic") -> Column:
    m, year = m_squared(r, b, rf, scale), annualized(b, scale, "arithmetic")
    return m - year if method == "arithmetic" else (1 + m) / (1 + year) - 1


def m_squared_sortino(r: Column, b: Column, mar: Number, scale: float) -> Column:
    root = float(scale) ** 0.5
    return annualized(r, scale) + sortino(r, mar) * root * (downside_deviation(b, mar) - downside_deviation(r, mar)) * root


def kelly(r: Column, rf: Number, fraction: float = 0.5) -> Column:
    return safe(F.avg(r - _c(rf)), F.var_samp(r)) * fraction


def up_capture(r: Column, b: Column) -> Column:
    return safe(F.avg(F.when(b > 0, r)), F.avg(F.when(b > 0, b)))


def down_capture(r: Column, b: Column) -> Column:
    return safe(F.avg(F.when(b < 0, r)), F.avg(F.when(b < 0, b)))


def up_down(r: Column, b: Column) -> dict[str, Column]:
    """Number, percent and capture of up and down periods against the benchmark."""
    both = lambda c: F.sum(c.cast("long"))
    return {
        "up_number": safe(both((r > 0) & (b > 0)).cast("double"), both(b > 0).cast("double")),
        "down_number": safe(both((r < 0) & (b < 0)).cast("double"), both(b < 0).cast("double")),
        "up_percent": safe(both((r > b) & (b > 0)).cast("double"), both(b > 0).cast("double")),
        "down_percent": safe(both((r > b) & (b < 0)).cast("double"), both(b < 0).cast("double")),
        "up_capture": up_capture(r, b),
        "down_capture": down_capture(r, b),
    }


def bernardo_ledoit(r: Column) -> Column:
    return omega(r, 0.0)


def d_ratio(r: Column) -> Column:
    down, up = F.sum((r < 0).cast("double")), F.sum((r > 0).cast("double"))
    return safe(down * F.sum(F.greatest(-r, F.lit(0.0))), up * F.sum(F.greatest(r, F.lit(0.0))))


def prospect_ratio(r: Column, mar: Number, loss: float = 2.25) -> Column:
    gain = F.avg(F.greatest(r, F.lit(0.0)) + loss * F.least(r, F.lit(0.0)))
    return safe(gain - _c(mar), downside_deviation(r, mar))


# co-moments


def co_moments(r: Column, b: Column) -> dict[str, Column]:
    return {
        "coskewness": safe(m12(r, b), F.stddev_pop(r) * m2(b)),
        "cokurtosis": safe(m13(r, b), F.stddev_pop(r) * F.pow(m2(b), F.lit(1.5))),
        "beta_covariance": safe(m11(r, b), m2(b)),
        "beta_coskewness": safe(m12(r, b), m3(b)),
        "beta_cokurtosis": safe(m13(r, b), m4(b)),
    }
