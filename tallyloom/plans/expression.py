"""Expressions of the step language as Columns, by precedence climbing."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from .lexer import SyntaxProblem, Token, tokenize, unquote

_BINDING = {"|": 1, "&": 2, "=": 4, "^=": 4, "~=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "||": 5, "+": 6, "-": 6, "*": 7, "/": 7, "**": 9}
_MAKE: dict[str, Callable[[Column, Column], Column]] = {
    "|": lambda a, b: _bool(a) | _bool(b),
    "&": lambda a, b: _bool(a) & _bool(b),
    # a missing value equals itself and is less than all others; beside a literal this folds to a filter that scans can take
    "=": lambda a, b: a.eqNullSafe(b),
    "^=": lambda a, b: ~a.eqNullSafe(b),
    "~=": lambda a, b: ~a.eqNullSafe(b),
    "<>": lambda a, b: ~a.eqNullSafe(b),
    "<": lambda a, b: (a < b) | (a.isNull() & b.isNotNull()),
    "<=": lambda a, b: (a <= b) | a.isNull(),
    ">": lambda a, b: (a > b) | (a.isNotNull() & b.isNull()),
    ">=": lambda a, b: (a >= b) | b.isNull(),
    "||": F.concat,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / F.nullif(b, F.lit(0)),
    "**": F.pow,
}


def _bool(c: Column) -> Column:
    return c.cast("boolean")


def _not(c: Column) -> Column:
    """A missing value is false, so its opposite is true."""
    return ~F.coalesce(_bool(c), F.lit(False))


class Text(str):
    """A literal's value beside its Column, for functions that take formats and lists."""


_FUNCTIONS: dict[str, Callable] = {
    "sum": S.sum_of, "mean": S.mean_of, "min": S.min_of, "max": S.max_of, "range": S.range_of, "n": S.n_of, "nmiss": S.nmiss_of, "cmiss": S.nmiss_of, "std": S.std_of, "var": S.var_of,
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "int": S.int_, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sign": F.signum,
    "round": S.round_to, "mod": S.mod, "substr": S.substr, "trim": S.trim, "left": S.left, "upcase": F.upper, "lowcase": F.lower, "strip": F.trim, "reverse": F.reverse, "length": S.length, "index": S.index, "countw": S.countw, "tranwrd": S.tranwrd,
    "cat": F.concat, "cats": S.cats, "catt": S.catt, "mdy": S.mdy, "date": F.current_date, "today": F.current_date, "datetime": F.localtimestamp, "datepart": F.to_date, "timepart": S.timepart, "hms": S.hms, "dhms": S.dhms, "year": F.year, "month": F.month, "day": F.day, "qtr": F.quarter,
    "coalesce": F.coalesce, "coalescec": F.coalesce, "ifn": lambda c, a, b: S.ifn(_bool(c), a, b), "ifc": lambda c, a, b: S.ifn(_bool(c), a, b), "missing": S.missing, "yrdif": lambda a, b, *_: S.yrdif(a, b),
}
#: Functions whose listed arguments must be literals.
_LITERAL: dict[str, tuple[Callable, tuple[int, ...]]] = {
    "scan": (S.scan, (2,)), "compress": (S.compress, (1,)), "translate": (S.translate, (1, 2)), "count": (S.count, (1,)), "verify": (S.verify, (1,)), "catx": (S.catx, (0,)), "intck": (S.intck, (0,)), "intnx": (S.intnx, (0, 3)), "right": (lambda s, n="0": S.right(s, int(n)), (1,)),
}


def _date(text: str) -> Column:
    return F.lit(datetime.datetime.strptime(text.strip().title(), "%d%b%Y").date())


def _datetime(text: str) -> Column:
    day, _, clock = text.strip().partition(":")
    return F.lit(f"{datetime.datetime.strptime(day.title(), '%d%b%Y').date()} {clock}").cast("timestamp_ntz")


def _time(text: str) -> Column:
    h, m, *s = text.strip().split(":")
    return F.lit(float(int(h) * 3600 + int(m) * 60 + float(s[0] if s else 0)))


class Parser:
    """Reads one expression from tokens; name gives the Column of a variable,
    order the window of lag and dif."""

    def __init__(self, tokens: list[Token], name: Callable[[str], Column], order: Callable[[], object] | None = None):
        self.tokens, self.at, self.name, self.order = tokens, 0, name, order

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k].low if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> Token:
        if self.at >= len(self.tokens):
            raise SyntaxProblem(f"expression ends where {want or 'a value'} is expected")
        t = self.tokens[self.at]
        if want is not None and t.low != want:
            raise SyntaxProblem(f"expected {want}, found {t.text}")
        self.at += 1
        return t

    def whole(self) -> Column:
        c = self.expression(0)
        if self.at < len(self.tokens):
            raise SyntaxProblem(f"unexpected {self.tokens[self.at].text}")
        return c

    def expression(self, least: int) -> Column:
        left = self.unary()
        while True:
            op = self.peek()
            negated = op in ("^", "~") and self.peek(1) in ("in", "like", "between")
            word = self.peek(1) if negated else op
            if word in ("in", "like", "between", "is") and least <= 4:
                self.at += 1 + negated
                left = self.word(left, word)
                left = _not(left) if negated else left
            elif op in _BINDING and self.tokens[self.at].kind == "op" and _BINDING[op] > least:
                self.take()
                # ** binds to the right
                left = _MAKE[op](left, self.expression(_BINDING[op] - (op == "**")))
            else:
                return left

    def word(self, left: Column, word: str) -> Column:
        if word == "in":
            self.take("(")
            values = []
            while self.peek() != ")":
                values.append(self.unary())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return left.isin(*values) if values else F.lit(False)
        if word == "like":
            return left.like(unquote(self.take().text))
        if word == "between":
            low = self.expression(4)
            self.take("&")
            return left.between(low, self.expression(4))
        no = self.peek() in ("^", "~")
        self.at += no
        if self.take().low not in ("null", "missing"):
            raise SyntaxProblem("expected NULL or MISSING")
        return left.isNotNull() if no else left.isNull()

    def unary(self) -> Column:
        op = self.peek()
        if op in ("-", "+"):
            self.take()
            c = self.expression(8)
            return -c if op == "-" else c
        if op in ("^", "~"):
            self.take()
            return _not(self.expression(3))
        return self.primary()

    def primary(self) -> Column:
        t = self.take()
        if t.kind == "number":
            return F.lit(float(t.text) if any(c in t.low for c in ".e") else int(t.text))
        if t.kind in ("string", "date", "datetime", "time"):
            return {"string": F.lit, "date": _date, "datetime": _datetime, "time": _time}[t.kind](unquote(t.text))
        if t.text == "(":
            c = self.expression(0)
            self.take(")")
            return c
        if t.text == ".":
            return F.lit(None)
        if t.kind == "name":
            if self.peek() == "(":
                return self.call(t.low)
            if t.low in ("first", "last") and self.peek() == ".":
                self.take()
                return self.name(f"{t.low}.{self.take().low}")
            return self.name(t.text)
        raise SyntaxProblem(f"unexpected {t.text}")

    def call(self, function: str) -> Column:
        self.take("(")
        if function in ("put", "input"):
            value = self.expression(0)
            self.take(",")
            fmt = ""
            while self.peek() != ")":
                fmt += self.take().text
            self.take(")")
            return (S.put if function == "put" else S.input_)(value, fmt)
        args: list[tuple[Column, list[Token]]] = []
        while self.peek() != ")":
            begin = self.at
            args.append((self.expression(0), self.tokens[begin : self.at]))
            if self.peek() == ",":
                self.take()
        self.take(")")
        if function in ("lag", "dif"):
            if self.order is None:
                raise SyntaxProblem(f"{function} needs an order")
            last = F.lag(args[0][0]).over(self.order())
            return last if function == "lag" else args[0][0] - last
        if function in _FUNCTIONS:
            return _FUNCTIONS[function](*[c for c, _ in args])
        if function in _LITERAL:
            make, literal = _LITERAL[function]
            return make(*[(unquote(t[0].text) if t[0].kind == "string" else t[0].text) if i in literal else c for i, (c, t) in enumerate(args)])
        raise SyntaxProblem(f"unknown function {function}")


def column(source: str | list[Token], name: Callable[[str], Column] = F.col, order: Callable[[], object] | None = None) -> Column:
    return Parser(tokenize(source) if isinstance(source, str) else source, name, order).whole()
