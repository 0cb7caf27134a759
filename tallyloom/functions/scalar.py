"""Scalar functions of the step language as Column builders.

Missing values are SQL nulls.  Everything is a built-in expression, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _count_present(xs: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(x.isNull(), 0).otherwise(1) for x in xs])


def sum_of(*xs: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in xs])
    return F.when(_count_present(xs) > 0, total)


def mean_of(*xs: Column) -> Column:
    return sum_of(*xs) / F.nullif(_count_present(xs), F.lit(0))


def min_of(*xs: Column) -> Column:
    return F.least(*xs)


def max_of(*xs: Column) -> Column:
    return F.greatest(*xs)


def range_of(*xs: Column) -> Column:
    return F.greatest(*xs) - F.least(*xs)


def n_of(*xs: Column) -> Column:
    return _count_present(xs)


def nmiss_of(*xs: Column) -> Column:
    return F.lit(len(xs)) - _count_present(xs)


def var_of(*xs: Column) -> Column:
    n, mu = _count_present(xs), mean_of(*xs)
    squares = reduce(lambda a, b: a + b, [F.coalesce((x - mu) * (x - mu), F.lit(0.0)) for x in xs])
    return F.when(n > 1, squares / F.nullif(n - 1, F.lit(0)))


def std_of(*xs: Column) -> Column:
    return F.sqrt(var_of(*xs))


def int_(x: Column) -> Column:
    """The whole part, towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_to(x: Column, unit: Column | float = 1.0) -> Column:
    u = _text(unit)
    return F.round(x / u) * u


def mod(x: Column, y: Column) -> Column:
    return x % F.nullif(_text(y), F.lit(0))


def substr(s: Column, pos: Column | int, n: Column | int | None = None) -> Column:
    return F.substring(s, _text(pos), _text(n) if n is not None else F.length(s))


def scan(s: Column, k: Column | int, delims: str = " ") -> Column:
    """The k-th word; from the end if k is negative."""
    return F.split_part(F.trim(s), F.lit(delims), _text(k))


def trim(s: Column) -> Column:
    return F.rtrim(s)


def left(s: Column) -> Column:
    return F.ltrim(s)


def right(s: Column, width: int) -> Column:
    return F.lpad(F.rtrim(s), width, " ")


def compress(s: Column, chars: str | None = None) -> Column:
    return F.replace(s, F.lit(" "), F.lit("")) if chars is None else F.translate(s, chars, "")


def tranwrd(s: Column, old: Column | str, new: Column | str) -> Column:
    return F.replace(s, _text(old), _text(new))


def translate(s: Column, to: str, of: str) -> Column:
    """Note the order: replacement characters first."""
    return F.translate(s, of, to)


def length(s: Column) -> Column:
    return F.length(F.rtrim(s))


def index(s: Column, part: Column | str) -> Column:
    return F.instr(s, _text(part))


def count(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def countw(s: Column) -> Column:
    return F.when(F.trim(s) == "", 0).otherwise(F.size(F.split(F.trim(s), "[ ,]+")))


def verify(s: Column, chars: str) -> Column:
    """Place of the first character that isn't among chars, else 0."""
    ok = F.length(F.regexp_extract(s, "^[" + "".join(f"\\{c}" if not c.isalnum() else c for c in chars) + "]*", 0))
    return F.when(ok == F.length(s), 0).otherwise(ok + 1)


def cats(*xs: Column) -> Column:
    return F.concat(*[F.trim(x) for x in xs])


def catt(*xs: Column) -> Column:
    return F.concat(*[F.rtrim(x) for x in xs])


def catx(delim: str, *xs: Column) -> Column:
    return F.concat_ws(delim, *[F.nullif(F.trim(x), F.lit("")) for x in xs])


def put(x: Column, fmt: str) -> Column:
    """Formats yymmdd10., date9., commaW.D, dollarW.D, zW. and W.D."""
    name = fmt.lower().rstrip(".")
    if name.startswith("yymmdd"):
        return F.date_format(x, "yyyy-MM-dd")
    if name.startswith("date"):
        return F.upper(F.date_format(x, "ddMMMyyyy"))
    digits = int(name.partition(".")[2] or 0)
    if name.startswith("comma"):
        return F.format_number(x, digits)
    if name.startswith("dollar"):
        return F.concat(F.lit("$"), F.format_number(x, digits))
    if name.startswith("z"):
        return F.lpad(x.cast("long").cast("string"), int(name[1:].partition(".")[0]), "0")
    return F.format_string(f"%.{digits}f", x.cast("double"))


def input_(s: Column, informat: str) -> Column:
    name = informat.lower().rstrip(".")
    if name.startswith("yymmdd"):
        return F.to_date(s, "yyyy-MM-dd")
    if name.startswith("date"):
        return F.to_date(F.initcap(s), "ddMMMyyyy")
    return s.try_cast("double")


def mdy(m: Column, d: Column, y: Column) -> Column:
    return F.make_date(_text(y), _text(m), _text(d))


def timepart(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hms(h: Column, m: Column, s: Column) -> Column:
    return h * 3600 + m * 60 + s


def dhms(d: Column, h: Column | int, m: Column | int, s: Column | int) -> Column:
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), _text(h), _text(m), _text(s))


def intck(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit between two dates."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return {"day": F.datediff(b, a), "month": months, "year": F.year(b) - F.year(a), "qtr": (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)}[unit.lower()]


def intnx(unit: str, d: Column, n: Column | int, align: str = "b") -> Column:
    if unit.lower() == "day":
        return F.date_add(d, _text(n))
    step = {"month": 1, "qtr": 3, "year": 12}[unit.lower()]
    moved = F.add_months(d, _text(n) * step)
    return moved if align.lower().startswith("s") else F.trunc(moved, {"month": "MM", "qtr": "quarter", "year": "year"}[unit.lower()])


def yrdif(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 365.25


def ifn(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


def missing(x: Column) -> Column:
    return x.isNull().cast("int")
