"""Programs of the step language, compiled to lazy DataFrames.

Source text is expanded by the macro interpreter, cut into statements, and each
step becomes one plan bound to the next version of its dataset.  Nothing is
executed here but the listing of ID values for PROC TRANSPOSE, and a step with
CALL SYMPUT, as later text depends on it; other actions are the caller's.

Rules of DATA steps: statements apply in order, each to all rows; a comparison
assigned to a variable is 1 or 0; a new variable that only some rows assign is
missing elsewhere; OUTPUT collects the row as it is at that point.  Rows have no
order of their own in a DataFrame: LAG, DIF, RETAIN and sum statements follow
the BY variables and the last PROC SORT of the input, each in its direction,
then all columns.  Steps that carry other state, or loop, run row by row (see
sequential).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import steps as O
from ..sources.tables import Library, parse_datalines, read_csv, write_csv
from .expression import Parser
from .lexer import SyntaxProblem, Token, tokenize, unquote
from .macro import Expander

_LINES = re.compile(r"\b(datalines|cards)\s*;[ \t]*\n(.*?)^[ \t]*;", re.I | re.S | re.M)


@dataclass
class Step:
    """What a step reads and writes, for lineage."""

    name: str
    kind: str
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)


def split_statements(text: str) -> list[str]:
    """Statements without comments and semicolons; quoted text stays whole."""
    text = re.sub(r"""('(?:[^']|'')*'|"(?:[^"]|"")*")|/\*.*?\*/""", lambda m: m[1] or " ", text, flags=re.S)
    out, quote, begin = [], "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append(text[begin:i].strip())
            begin = i + 1
    if text[begin:].strip():
        out.append(text[begin:].strip())
    return [s for s in out if s and not s.startswith("*")]


def _pieces(source: str) -> list[str]:
    """Source text cut after each RUN outside macro definitions."""
    out, begin, depth = [], 0, 0
    for m in re.finditer(r"%macro\b|%mend\b|\brun\s*;", source, re.I):
        depth += {"%macro": 1, "%mend": -1}.get(m[0].lower(), 0)
        if not depth and m[0][0] != "%":
            out.append(source[begin : m.end()])
            begin = m.end()
    return [*out, source[begin:]]


def _ordered(order: list[tuple[str, bool]], columns: list[str]) -> list[Column]:
    """Sort columns, each in its direction (missing values are the least), then all others."""
    known, keys = {c.lower(): c for c in columns}, {}
    for c, down in order:
        if c.lower() in known:
            keys.setdefault(known[c.lower()], down)
    keys |= {c: False for c in columns if c not in keys and not c.startswith("__")}
    return [F.desc_nulls_last(F.col(f"`{c}`")) if d else F.asc_nulls_first(F.col(f"`{c}`")) for c, d in keys.items()]


@dataclass
class Reference:
    """A dataset name with its options."""

    name: str
    keep: list[str] | None = None
    drop: list[str] | None = None
    rename: dict[str, str] = field(default_factory=dict)
    where: list[Token] | None = None
    flag: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.where(Parser(self.where, F.col).whole().cast("boolean"))
        if self.keep is not None:
            df = O.keep(df, *self.keep)
        if self.drop:
            df = O.drop(df, *self.drop)
        return O.rename(df, **self.rename) if self.rename else df


def references(tokens: list[Token]) -> list[Reference]:
    """Dataset names, one or two levels, each with options in parentheses."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t.text == "(":
            depth, j = 1, i + 1
            while depth:
                if j >= len(tokens):
                    raise SyntaxProblem("unclosed dataset options")
                depth += {"(": 1, ")": -1}.get(tokens[j].text, 0)
                j += 1
            _options(out[-1], tokens[i + 1 : j - 1])
            i = j
        elif t.kind == "name":
            name = t.text
            if i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].kind == "name":
                name, i = f"{name}.{tokens[i + 2].text}", i + 2
            out.append(Reference(name))
            i += 1
        else:
            raise SyntaxProblem(f"unexpected {t.text} among datasets")
    return out


def _options(ref: Reference, tokens: list[Token]) -> None:
    i = 0
    while i < len(tokens):
        key = tokens[i].low
        if i + 1 >= len(tokens) or tokens[i + 1].text != "=":
            raise SyntaxProblem(f"dataset option {key} has no value")
        i += 2
        if key in ("where", "rename"):
            depth, j = 1, i + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(tokens[j].text, 0)
                j += 1
            inner, i = tokens[i + 1 : j - 1], j
            if key == "where":
                ref.where = inner
            else:
                names = [t.text for t in inner if t.text != "="]
                ref.rename = dict(zip(names[::2], names[1::2], strict=True))
        else:
            j = i
            while j < len(tokens) and not (j + 1 < len(tokens) and tokens[j + 1].text == "="):
                j += 1
            values, i = [t.text for t in tokens[i:j]], j
            if key == "in":
                ref.flag = values[0].lower()
            elif key in ("keep", "drop"):
                setattr(ref, key, values)


class Program:
    """A session: macro variables, libraries, and the steps compiled so far."""

    def __init__(self, spark: SparkSession, library: Library | None = None, include: Callable[[str], str] | None = None):
        self.spark = spark
        self.library = library or Library(spark)
        self.macros = Expander(include)
        self.steps: list[Step] = []
        self.printed: list[DataFrame] = []
        self._sorted: dict[str, list[tuple[str, bool]]] = {}
        self._lines: list[str] = []

    def run(self, source: str) -> Program:
        """Compile source text; datasets are then in the library, listings in printed."""

        def keep(m: re.Match) -> str:
            self._lines.append(m[2])
            return f"datalines {len(self._lines) - 1};"

        source = _LINES.sub(keep, source)
        # what CALL SYMPUT sets is known only when its step has run
        for part in _pieces(source) if re.search(r"\bsymputx?\b", source, re.I) else [source]:
            self._run(self.macros.expand(part))
        return self

    def _run(self, text: str) -> None:
        block: list[str] = []
        for s in split_statements(text):
            word = re.match(r"\w*", s)[0].lower()
            if word in ("data", "proc"):
                self._close(block)
                block = [s]
            elif word in ("run", "quit"):
                self._close(block)
                block = []
            elif not block:
                self._global(word, s)
            else:
                block.append(s)
        self._close(block)

    def _global(self, word: str, s: str) -> None:
        if word == "libname":
            m = re.match(r"libname\s+(\w+)\s+(['\"].*['\"])", s, re.I | re.S)
            if m:
                self.library.paths[m[1].lower()] = unquote(m[2])
        elif word not in ("filename", "options", "title", "title1", "title2", "footnote", "ods", "goptions"):
            raise SyntaxProblem(f"statement outside a step: {s[:60]}")

    def _close(self, block: list[str]) -> None:
        if not block:
            return
        if block[0].lower().startswith("data"):
            DataStep(self, block).compile()
        else:
            Procedure(self, block).compile()

    def read(self, ref: Reference, step: Step) -> DataFrame:
        step.reads.append(Library.key(ref.name))
        return ref.apply(self.library.get(ref.name))

    def write(self, ref: Reference, df: DataFrame, step: Step, order: list[tuple[str, bool]] = ()) -> None:
        step.writes.append(Library.key(ref.name))
        self.library.put(ref.name, ref.apply(df))
        self._sorted[Library.key(ref.name)] = list(order)

    def order_of(self, name: str) -> list[tuple[str, bool]]:
        return self._sorted.get(Library.key(name), [])

    def lineage(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the compiled steps; a rewritten dataset has a node for each version."""
        from .graph import build

        nodes: dict[str, tuple[str, str, str]] = {}
        edges, version = [], {}
        for i, s in enumerate(self.steps):
            step = f"{i + 1}:{s.name}"
            nodes[step] = (step, s.kind, s.name)
            proc = s.kind == "PROC_STEP"
            for name in dict.fromkeys(s.reads):
                node = f"{name}@{version.get(name, 0)}"
                nodes.setdefault(node, (node, "DATASET", name))
                edges.append((node, step, "PROC_INPUT" if proc else "READS_FROM"))
            for name in dict.fromkeys(s.writes):
                version[name] = version.get(name, 0) + 1
                node = f"{name}@{version[name]}"
                nodes[node] = (node, "DATASET", name)
                edges.append((step, node, "PROC_OUTPUT" if proc else "WRITES_TO"))
        return build(self.spark, nodes.values(), edges)


class DataStep:
    def __init__(self, program: Program, block: list[str]):
        self.program, self.statements = program, [tokenize(s) for s in block]
        self.outputs = references(self.statements[0][1:])
        self.step = Step("data " + " ".join(r.name for r in self.outputs), "DATA_STEP")
        self.df: DataFrame | None = None
        self.by: list[str] = []
        self.down: dict[str, bool] = {}
        self.order: list[tuple[str, bool]] = []
        self.flags: dict[str, Column] = {}
        self.output: dict[str, list[DataFrame]] = {}
        self.explicit = False
        self.lengths: dict[str, int] = {}
        self.meta: dict[str, dict] = {}
        self.finish: list[Callable[[DataFrame], DataFrame]] = []
        self.columns: list[tuple[str, str]] = []
        self.informats: dict[str, str] = {}
        self.end: str | None = None
        self.at = 1

    # --- driving ---
    def compile(self) -> None:
        for s in self.statements:
            if s[0].low == "by" and len(s) > 1:
                self.by = [t.text for t in s[1:] if t.low != "descending"]
                self.down = {t.low: s[i - 1].low == "descending" for i, t in enumerate(s) if i and t.low != "descending"}
        body = self.statements[1:]
        if self.carries_state(body):
            self.by_rows(body)
        else:
            while self.at <= len(body):
                self.statement(body[self.at - 1], None)
                self.at += 1
            if self.df is None:
                self.df = self.program.spark.range(1).select()
        for ref in self.outputs:
            name = ref.name.lower()
            if name == "_null_":
                continue
            parts = self.output.get(name, []) if self.explicit else [self.df]
            df = O.stack(*parts) if parts else self.df.limit(0)
            for change in self.finish:
                df = change(df)
            df = O.drop(df, *[c for c in df.columns if c.startswith("__")])
            for c, info in self.meta.items():
                if match := next((x for x in df.columns if x.lower() == c), None):
                    df = df.withMetadata(match, info)
            self.program.write(ref, df, self.step, self.order)
        self.program.steps.append(self.step)

    # --- row by row ---
    def carries_state(self, body: list[list[Token]]) -> bool:
        """Whether a statement needs what earlier rows or turns left."""
        sums = {s[0].low: i for i, s in reversed(list(enumerate(body))) if len(s) > 2 and s[1].text == "+" and s[0].kind == "name"}
        for i_s, s in enumerate(body):
            low = [t.low for t in s]
            names = {t.low for t in s if t.kind == "name"}
            if low[0] == "retain" and len(s) > 1 or low[0] in ("array", "stop") or low[-1] == "stop" or names & {"symput", "symputx"}:
                return True
            if "_n_" in names or low[0] == "do" and (low[1:2] in (["while"], ["until"]) or set(low) & {"while", "until"}):
                return True
            if low[0] == "set" and any(a == "end" and b == "=" for a, b in zip(low, low[1:], strict=False)):
                return True
            if low[0] in ("if", "else", "when", "otherwise") and any(a in ("lag", "dif") and b == "(" for a, b in zip(low, low[1:], strict=False)):
                return True
            # a running sum that is set other than by IF FIRST.x THEN name = constant
            set_here = [low[i] for i in range(len(s) - 1) if low[i + 1] == "=" and (i == 0 or low[i - 1] in ("then", "else"))]
            plain = low[0] == "if" and low[1:2] == ["first"] and low[4:5] == ["then"] and low[3] in [b.lower() for b in self.by] and len(s) == 8 and s[7].kind == "number" and float(s[7].text) == 0 and i_s < sums.get(low[5], 0)
            if any(x in sums for x in set_here) and not plain:
                return True
            if low[0] == "if" and len(low) > 1 and "+" in low and "then" in low:
                at = low.index("then") + 1
                if at + 1 < len(low) and low[at + 1] == "+" and low[at] in {x for t in body for x in [t[0].low]}:
                    return True
        if any(s[0].low == "do" and len(s) > 1 for s in body) and not any(t.low == "output" for s in body for t in s):
            return True
        # the value of a running sum before its statement is that of the row before
        for name in sums:
            at = next(i for i, s in enumerate(body) if s[0].low == name and len(s) > 2 and s[1].text == "+")
            if any(t.low == name for s in body[:at] for k, t in enumerate(s) if s[0].low not in ("keep", "drop", "length", "format", "label", "retain") and not (k + 1 < len(s) and s[k + 1].text == "=")):
                return True
        return False

    def by_rows(self, body: list[list[Token]]) -> None:
        """Run the statements row by row, over rows in order."""
        from .sequential import RowStep

        declared = ("set", "merge", "update", "modify", "where", "keep", "drop", "rename", "length", "format", "informat", "label", "by", "input", "datalines", "cards", "infile")
        for s in body:
            if s[0].low in declared:
                self.statement(s, None)
        spark = self.program.spark
        if self.df is None:
            self.df = spark.range(1).select(F.lit(1).alias("__one"))
        flags = {f: self.flags[f].cast("int") for f in self.flags}
        source = self.df.withColumns({f"__flag_{f}": c for f, c in flags.items()})
        given = {c.lower(): c for c in source.columns if not c.startswith("__")}
        row = RowStep([s for s in body if s[0].low not in declared], [r.name.lower() for r in self.outputs], self.lengths)
        state = set(row.first) | set(row.queues) | (row.uses & {"_n_"}) | ({self.end} if self.end else set())
        stops = any(t.low == "stop" for s in body for t in s)
        by = [self.find(b) for b in self.by]
        fresh = 0
        if state or stops or by:
            order = _ordered([*[(b, self.down.get(b.lower(), False)) for b in self.by], *self.order], [c for c in source.columns if not c.startswith("__")])
            fresh = 0 if stops or self.end or "_n_" in row.uses else self.fresh_groups(body, row) if row.first else len(by)
            source = (source.repartition(*[F.col(f"`{b}`") for b in by[:fresh]]) if fresh else source.coalesce(1)).sortWithinPartitions(*order)
        types = {c.lower(): source.schema[c].dataType.simpleString() for c in given.values()}
        new = {n: name for n, name in row.names.items() if n not in given}
        schema = {**{c: types[c.lower()] for c in given.values()}, **{name: "string" if n in row.texts or n in self.lengths and self.meta.get(n, {}).get("text") else "double" for n, name in new.items()}}
        ddl = ", ".join(f"`{c}` {t}" for c, t in {"__out": "string", **schema, "__name": "string", "__value": "string"}.items())
        columns, keys, end = list(schema), [b.lower() for b in by], self.end
        double = {c for c, t in schema.items() if t == "double"}
        whole = {c for c, t in schema.items() if t in ("int", "bigint", "smallint", "tinyint")}

        def run(batches):
            import pandas as pd

            def rows():
                for batch in batches:
                    names = [c[7:] if c.startswith("__flag_") else c.lower() for c in batch.columns]
                    for values in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                        yield dict(zip(names, values, strict=True))

            def frame(found):
                out = {"__out": [n for n, _ in found]}
                for c in columns:
                    x = [r.get(c.lower()) for _, r in found]
                    out[c] = pd.array([None if v is None else float(v) for v in x], "Float64") if c in double else pd.array([None if v is None else int(v) for v in x], "Int64") if c in whole else pd.Series(x, dtype=object)
                out["__name"] = pd.Series([r.get("name") if n == " say" else None for n, r in found], dtype=object)
                out["__value"] = pd.Series([r.get("value") if n == " say" else None for n, r in found], dtype=object)
                return pd.DataFrame(out)

            found = []
            for one in row.rows(rows(), keys, fresh, end):
                found.append(one)
                if len(found) >= 10_000:
                    yield frame(found)
                    found = []
            if found:
                yield frame(found)

        done = source.mapInPandas(run, ddl)
        if "symput" in row.uses or "symputx" in row.uses:
            from ..sources.cut import cut

            done = cut(done.withColumn("__at", F.monotonically_increasing_id()))
            for r in done.where("__out = ' say'").groupBy("__name").agg(F.max_by("__value", "__at").alias("value")).collect():
                self.program.macros.scopes[0][r["__name"].lower()] = r.value
        drop = [c for c in done.columns if c.startswith("__")]
        self.explicit = True
        for r in self.outputs:
            self.output[r.name.lower()] = [done.where(F.col("__out") == r.name.lower()).drop(*drop)]

    def fresh_groups(self, body: list[list[Token]], row) -> int:
        """How many leading BY variables make a group with which all retained
        variables are set anew by IF FIRST.x at the step's begin; 0 if none does."""
        names = [b.lower() for b in self.by]
        least = len(names)
        for v in row.first:
            level = None
            for i, s in enumerate(body):
                low = [t.low for t in s]
                if low[0] == "if" and low[1:3] == ["first", "."] and len(low) > 4 and low[3] in names and low[4] == "then":
                    inside = [low[5:7]] if low[5] != "do" else []
                    for t in body[i + 1 :] if low[5] == "do" else []:
                        if t[0].low == "end":
                            break
                        inside.append([x.low for x in t[:2]])
                    if [v, "="] in inside:
                        level = names.index(low[3]) + 1
                        break
                elif any(t.low == v for t in s) and low[0] not in ("retain", "array", "keep", "drop", "length", "format", "label", "by", "set"):
                    break  # read before it is set
            if level is None:
                return 0
            least = min(least, level)
        return least

    # --- variables and expressions ---
    def find(self, name: str) -> str | None:
        return next((c for c in (self.df.columns if self.df is not None else []) if c.lower() == name.lower()), None)

    def variable(self, name: str) -> Column:
        low = name.lower()
        if low in self.flags:
            return self.flags[low]
        if low.startswith(("first.", "last.")):
            return self._edge(*low.split("."))
        if (c := self.find(name)) is None:
            raise SyntaxProblem(f"variable {name} doesn't exist")
        return F.col(f"`{c}`")

    def window(self):
        order = [*self.keys(), *self.order]
        if not order:
            raise SyntaxProblem("the input has no order; sort it or use BY")
        w = Window.partitionBy(*[F.col(f"`{b}`") for b in self.by]) if self.by else Window.partitionBy()
        return w.orderBy(*_ordered(order, self.df.columns))

    def keys(self) -> list[tuple[str, bool]]:
        """The BY variables, each with its direction."""
        return [(b, self.down.get(b.lower(), False)) for b in self.by]

    def _edge(self, which: str, name: str) -> Column:
        """FIRST. or LAST. of a BY variable, as a column made before the rows change."""
        column = f"__{which}_{name}"
        if column not in self.df.columns:
            upto = [b for b in self.by][: [b.lower() for b in self.by].index(name) + 1]
            rest = [c for c in self.df.columns if c.lower() not in [b.lower() for b in upto]]
            w = Window.partitionBy(*upto).orderBy(*(_ordered([*self.keys(), *self.order], rest) or [F.lit(1)]))
            edge = F.row_number().over(w) == 1 if which == "first" else F.lead(F.lit(1)).over(w).isNull()
            self.df = self.df.withColumn(column, edge)
        return F.col(column)

    def expression(self, tokens: list[Token]) -> Column:
        for i, t in enumerate(tokens):  # flags are added to the rows before they are used
            if t.low in ("first", "last") and i + 2 < len(tokens) and tokens[i + 1].text == ".":
                self._edge(t.low, tokens[i + 2].low)
        return Parser(tokens, self.variable, self.window).whole()

    def condition(self, tokens: list[Token]) -> Column:
        return F.coalesce(self.expression(tokens).cast("boolean"), F.lit(False))

    def assign(self, name: str, value: Column, when: Column | None) -> None:
        if dict(self.df.select(value.alias("x")).dtypes)["x"] == "boolean":
            value = F.coalesce(value, F.lit(False)).cast("int")
        if name.lower() in self.lengths:
            value = F.substring(value.cast("string"), 1, self.lengths[name.lower()])
        old = self.find(name)
        if when is not None:
            kept = F.col(f"`{old}`") if old else F.lit(None)
            value = F.when(when, value).otherwise(kept)
        self.df = self.df.withColumn(old or name, value)

    # --- statements ---
    def statement(self, s: list[Token], when: Column | None) -> None:
        word = s[0].low
        if len(s) > 1 and s[1].text == "=" and s[0].kind == "name":
            self.assign(s[0].text, self.expression(s[2:]), when)
        elif len(s) > 2 and s[1].text == "+" and s[0].kind == "name" and word not in ("if",):
            self.sum_statement(s[0].text, s[2:], when)
        elif hasattr(self, f"do_{word}"):
            getattr(self, f"do_{word}")(s, when)
        else:
            raise SyntaxProblem(f"statement {s[0].text} isn't supported")

    def _inputs(self, s: list[Token]) -> list[tuple[Reference, DataFrame]]:
        s = list(s)
        for i in range(len(s) - 2):
            if s[i].low == "end" and s[i + 1].text == "=":  # SET option
                self.end = s[i + 2].low
                del s[i : i + 3]
                break
        refs = references(s[1:])
        self.order = list(self.program.order_of(refs[0].name)) if len(refs) == 1 else self.keys()
        return [(r, self.program.read(r, self.step)) for r in refs]

    def do_set(self, s, when):
        parts = self._inputs(s)
        flags = [r.flag for r, _ in parts if r.flag]
        frames = [df.withColumns({f"__in_{f}": F.lit(f == r.flag) for f in flags}) if flags else df for r, df in parts]
        self.df = O.stack(*frames)
        self.flags |= {f: F.col(f"__in_{f}") for f in flags}

    def do_merge(self, s, when):
        if not self.by:
            raise SyntaxProblem("MERGE needs BY")
        (r, df), *rest = self._inputs(s)
        df = df.withColumn(f"__in_{r.flag or 0}", F.lit(True))
        names, order = [r.flag or "0"], self.program.order_of(r.name)
        for i, (q, other) in enumerate(rest, 1):
            flag = q.flag or str(i)
            sides = _ordered(order, [c for c in df.columns if c not in self.by]), _ordered(self.program.order_of(q.name), [c for c in other.columns if c not in self.by])
            df = O.merge(df, other.withColumn(f"__in_{flag}", F.lit(True)), self.by, True, sides).drop("in_left", "in_right")
            names.append(flag)
        self.df = df.withColumns({f"__in_{n}": F.coalesce(f"__in_{n}", F.lit(False)) for n in names})
        self.flags |= {n: F.col(f"__in_{n}") for n in names if not n.isdigit()}

    def do_update(self, s, when):
        (_, a), (_, b) = self._inputs(s)
        self.df = O.update(a, b, self.by)

    do_modify = do_set

    def do_by(self, s, when):
        pass

    def do_where(self, s, when):
        self.df = self.df.where(self.condition(s[1:]))

    def do_keep(self, s, when):
        self.finish.append(lambda df, names=[t.text for t in s[1:]]: O.keep(df, *names))

    def do_drop(self, s, when):
        self.finish.append(lambda df, names=[t.text for t in s[1:]]: O.drop(df, *names))

    def do_rename(self, s, when):
        names = [t.text for t in s[1:] if t.text != "="]
        self.finish.append(lambda df: O.rename(df, **dict(zip(names[::2], names[1::2], strict=True))))

    def do_length(self, s, when):
        names: list[str] = []
        for i, t in enumerate(s[1:], 1):
            if t.kind == "number":
                for n in names:
                    self.lengths[n] = int(float(t.text))
                    self.meta.setdefault(n, {})["length"] = self.lengths[n]
                    if s[i - 1].text == "$":
                        self.meta[n]["text"] = True
                names = []
            elif t.kind == "name":
                names.append(t.low)

    def do_format(self, s, when):
        names: list[str] = []
        text = ""
        for t in s[1:]:
            if t.text == "." and names and text:
                for n in names[:-1]:
                    self.meta.setdefault(n, {})["format"] = names[-1] + "."
                names, text = [], ""
            elif t.kind in ("name", "number"):
                text = t.low
                names.append(t.low)

    do_informat = do_format

    def do_label(self, s, when):
        for i, t in enumerate(s):
            if t.text == "=" and i + 1 < len(s):
                self.meta.setdefault(s[i - 1].low, {})["label"] = unquote(s[i + 1].text)

    def do_retain(self, s, when):
        """RETAIN without names: all variables of a step that sets none anew keep their values."""

    def sum_statement(self, name: str, tokens: list[Token], when: Column | None) -> None:
        """name + expression; runs from the BY group's first row on if an IF FIRST. resets the variable, else over all rows."""
        reset = next((t[i + 2].text for t in self.statements if t[0].low == "if" for i in range(len(t) - 2) if t[1].low == "first" and t[3].low in map(str.lower, self.by) and t[i].low == "then" and t[i + 1].low == name.lower()), None)
        group = next((t[3].text for t in self.statements if reset is not None and t[0].low == "if" and t[1].low == "first"), None)
        part = self.by[: [b.lower() for b in self.by].index(group.lower()) + 1] if group else []
        value = F.coalesce(self.expression(tokens), F.lit(0))
        value = F.when(when, value).otherwise(F.lit(0)) if when is not None else value
        rest = [c for c in self.df.columns if c not in part and c.lower() != name.lower()]
        w = Window.partitionBy(*part).orderBy(*_ordered([*self.keys(), *self.order], rest)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.df = self.df.withColumn(self.find(name) or name, F.sum(value).over(w))

    def do_if(self, s, when):
        cut = next((i for i, t in enumerate(s) if t.low == "then"), None)
        if cut is None:  # subsetting IF
            keep = self.condition(s[1:])
            self.df = self.df.where(keep if when is None else F.coalesce(~when, F.lit(True)) | keep)
            return
        flag = f"__if{self.at}_{len(self.df.columns)}"
        cond = self.condition(s[1:cut])
        # kept in a column, as the branch may change what the condition reads
        self.df = self.df.withColumn(flag, cond if when is None else when & cond)
        self.branch(s[cut + 1 :], F.col(flag))
        body = self.statements[1:]
        if self.at < len(body) and body[self.at][0].low == "else":
            other = body[self.at][1:]
            self.at += 1
            inverse = ~F.col(flag) if when is None else when & ~F.col(flag)
            self.branch(other, inverse)

    def branch(self, s: list[Token], when: Column) -> None:
        if s and s[0].low == "do" and len(s) == 1:
            self.block(when)
        elif s:
            self.statement(s, when)

    def block(self, when: Column | None) -> None:
        body = self.statements[1:]
        while True:
            self.at += 1
            if self.at > len(body):
                raise SyntaxProblem("DO without END")
            if body[self.at - 1][0].low == "end":
                return
            self.statement(body[self.at - 1], when)

    def do_do(self, s, when):
        if len(s) == 1:
            self.block(when)
            return
        words = [t.low for t in s]
        if "to" not in words or when is not None:
            raise SyntaxProblem("only DO ... TO ... loops outside conditions are supported")
        to, by = words.index("to"), words.index("by") if "by" in words else len(s)
        if self.df is None:
            self.df = self.program.spark.range(1).select()
        step = int("".join(t.text for t in s[by + 1 :]) or 1)
        before = self.df
        start, stop = (self.expression(x).cast("int") for x in (s[3:to], s[to + 1 : by]))
        self.df = O.do_loop(before, s[1].text, start, stop, step)
        self.block(None)
        if not self.explicit:
            raise SyntaxProblem("a DO loop without OUTPUT isn't supported")

    def do_select(self, s, when):
        body = self.statements[1:]
        subject = s[2:-1] if len(s) > 1 else None
        rest = F.lit(True) if when is None else when
        while True:
            self.at += 1
            t = body[self.at - 1]
            if t[0].low == "end":
                return
            if t[0].low == "when":
                depth, j = 1, 2
                while depth:
                    depth += {"(": 1, ")": -1}.get(t[j].text, 0)
                    j += 1
                inside = t[2 : j - 1]
                if subject is None:
                    hit = self.condition(inside)
                else:
                    value = self.expression(subject)
                    choices = Parser([Token("op", "(", 0), *inside, Token("op", ")", 0)], self.variable)
                    hit = F.coalesce(choices.word(value, "in"), F.lit(False))
                flag = f"__when{self.at}"
                self.df = self.df.withColumn(flag, rest & hit)
                rest = rest & ~F.col(flag)
                self.branch(t[j:], F.col(flag))
            elif t[0].low == "otherwise":
                self.branch(t[1:], rest)

    def do_output(self, s, when):
        self.explicit = True
        rows = self.df if when is None else self.df.where(when)
        for name in [r.name.lower() for r in references(s[1:])] or [r.name.lower() for r in self.outputs]:
            self.output.setdefault(name, []).append(rows)

    def do_delete(self, s, when):
        self.df = self.df.where(F.lit(False) if when is None else F.coalesce(~when, F.lit(True)))

    def do_input(self, s, when):
        for i, t in enumerate(s[1:], 1):
            if t.text == "$":
                self.columns[-1] = (self.columns[-1][0], "string")
            elif t.kind == "name" and s[i - 1].text == ":":
                self.informats[self.columns[-1][0]] = t.text
                self.columns[-1] = (self.columns[-1][0], "string")
            elif t.kind == "name":
                self.columns.append((t.text, "double"))

    def do_datalines(self, s, when):
        text = self.program._lines[int(s[1].text)]
        lengths = {n: k for n, _ in self.columns if (k := self.lengths.get(n.lower()))}
        self.df = parse_datalines(self.program.spark, text, self.columns, self.informats, {n: k for n, k in lengths.items() if dict(self.columns)[n] == "string"})

    do_cards = do_datalines

    def do_infile(self, s, when):
        raise SyntaxProblem("INFILE isn't supported; use PROC IMPORT")


class Procedure:
    def __init__(self, program: Program, block: list[str]):
        self.program, self.block = program, block
        head = tokenize(block[0])
        self.name = head[1].low
        self.flags: set[str] = set()
        self.options: dict[str, list[Token]] = {}
        i = 2
        while i < len(head):
            key = head[i].low
            if i + 1 < len(head) and head[i + 1].text == "=":
                j, depth = i + 2, 0
                while j < len(head):
                    depth += {"(": 1, ")": -1}.get(head[j].text, 0)
                    nxt = head[j + 1] if j + 1 < len(head) else None
                    j += 1
                    if not depth and (nxt is None or nxt.text not in (".", "(") and head[j - 1].text != "."):
                        break
                self.options[key] = head[i + 2 : j]
                i = j
            else:
                self.flags.add(key)
                i += 1
        self.clauses = [tokenize(s) for s in block[1:]] if self.name != "sql" else []
        self.step = Step(f"proc {self.name}", "PROC_STEP")

    def clause(self, word: str) -> list[Token] | None:
        return next((c[1:] for c in self.clauses if c[0].low == word), None)

    def names(self, word: str) -> list[str]:
        return [t.text for t in self.clause(word) or [] if t.kind == "name" and t.low != "descending"]

    def data(self) -> DataFrame:
        df = self.program.read(references(self.options["data"])[0], self.step)
        where = self.clause("where")
        return df.where(Parser(where, F.col).whole().cast("boolean")) if where else df

    def put(self, df: DataFrame, tokens: list[Token] | None = None, order: list[str] = ()) -> None:
        target = tokens or self.options.get("out") or self.options.get("data")
        self.program.write(references(target)[0], df, self.step, order)

    def compile(self) -> None:
        make = getattr(self, f"proc_{self.name}", None)
        if make is None:
            raise SyntaxProblem(f"PROC {self.name.upper()} isn't supported")
        make()
        self.program.steps.append(self.step)

    def proc_sort(self) -> None:
        by, down = [], False
        for t in self.clause("by") or []:
            if t.low == "descending":
                down = True
            else:
                by.append((t.text, down))
                down = False
        df = self.data()
        order = [F.desc_nulls_last(c) if d else F.asc_nulls_first(c) for c, d in by]
        if "nodupkey" in self.flags:
            df = O.sort_nodupkey(df, [c for c, _ in by], [F.asc_nulls_first(c) for c in df.columns])
        self.put(df.orderBy(*order), order=by)

    def proc_print(self) -> None:
        df = self.data()
        self.program.printed.append(O.keep(df, *self.names("var")) if self.clause("var") else df)

    def _stats(self, cls: list[str]) -> None:
        df = self.data()
        var = self.names("var") or O.numeric_columns(df, cls)
        out = self.clause("output")
        if out is None:
            stats = [s for s in ("n", "mean", "std", "min", "max", "sum", "median", "var") if s in self.flags] or ["n", "mean", "std", "min", "max"]
            self.program.printed.append(O.means(df, var, stats, cls))
            return
        target: list[Token] = []
        columns: list[Column] = []
        i = 0
        while i < len(out):
            if out[i].low == "out":
                j = i + 2
                depth = 0
                while j < len(out) and (depth or j == i + 2 or out[j].text in (".", "(") or out[j - 1].text == "."):
                    depth += {"(": 1, ")": -1}.get(out[j].text, 0)
                    j += 1
                target, i = out[i + 2 : j], j
                continue
            stat, on = out[i].low, var
            i += 1
            if i < len(out) and out[i].text == "(":
                j = next(k for k in range(i, len(out)) if out[k].text == ")")
                on, i = [t.text for t in out[i + 1 : j]], j + 1
            names = []
            if i < len(out) and out[i].text == "=":
                i += 1
                while i < len(out) and out[i].kind == "name" and not (i + 1 < len(out) and out[i + 1].text in ("=", "(")):
                    names.append(out[i].text)
                    i += 1
            columns += [O._STATS[stat](v).alias(n) for v, n in zip(on, names or [f"{v}_{stat}" if len(on) > 1 else v for v in on], strict=False)]
        full = (1 << len(cls)) - 1
        if "nway" in self.flags or not cls:
            got = df.groupBy(*cls).agg(F.lit(full).cast("long").alias("_TYPE_"), F.count("*").alias("_FREQ_"), *columns)
        else:
            got = df.cube(*cls).agg((F.lit(full) - F.grouping_id()).cast("long").alias("_TYPE_"), F.count("*").alias("_FREQ_"), *columns)
        self.put(got, target)

    def proc_means(self) -> None:
        self._stats(self.names("class"))

    proc_summary = proc_means

    def proc_univariate(self) -> None:
        df = self.data()
        v = self.names("var")
        cols = [f(F.col(x)).alias(f"{x}_{n}") for x in v for n, f in {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "q1": lambda c: F.percentile(c, 0.25), "median": F.median, "q3": lambda c: F.percentile(c, 0.75)}.items()]
        self.program.printed.append(df.groupBy(*self.names("class")).agg(*cols))

    def proc_corr(self) -> None:
        df, v = self.data(), self.names("var")
        self.program.printed.append(df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for i, a in enumerate(v) for b in v[i + 1 :]]))

    def proc_freq(self) -> None:
        df, tables = self.data(), self.clause("tables") or []
        cut = next((i for i, t in enumerate(tables) if t.text == "/"), len(tables))
        one, i = [], 0
        spec, extra = tables[:cut], tables[cut + 1 :]
        results = []
        while i < len(spec):
            if i + 2 < len(spec) and spec[i + 1].text == "*":
                results.append(O.crosstab(df, spec[i].text, spec[i + 2].text))
                i += 3
            else:
                one.append(spec[i].text)
                i += 1
        if one:
            results.insert(0, O.freq(df, *one))
        self.program.printed += results
        if extra and extra[0].low == "out":
            self.put(results[-1], extra[2:])

    def proc_transpose(self) -> None:
        df, by, var = self.data(), self.names("by"), self.names("var")
        ident = self.names("id")
        if not ident:
            self.put(O.unpivot(df, by, var, "_NAME_", "COL1"))
            return
        values = [r[0] for r in df.select(F.col(ident[0]).cast("string")).distinct().orderBy(F.col(ident[0])).limit(10_001).collect()]
        if len(values) > 10_000:
            raise SyntaxProblem("PROC TRANSPOSE: more than 10000 values of ID")
        self.put(O.transpose(df.withColumn(ident[0], F.col(ident[0]).cast("string")), by, ident[0], var[0], values))

    def proc_append(self) -> None:
        base = references(self.options["base"])[0]
        more = self.data()
        self.program.write(base, O.stack(self.program.read(base, self.step), more) if base.name in self.program.library else more, self.step)

    def proc_compare(self) -> None:
        a = self.program.read(references(self.options["base"])[0], self.step)
        b = self.program.read(references(self.options["compare"])[0], self.step)
        by = self.names("id") or self.names("by")
        self.program.printed.append(O.compare(a, b, by, self.names("var") or O.numeric_columns(a, by)))

    def proc_contents(self) -> None:
        df = self.data()
        self.program.printed.append(self.program.spark.createDataFrame([(f.name, f.dataType.simpleString(), str(f.metadata)) for f in df.schema], "name string, type string, info string"))

    def proc_datasets(self) -> None:
        for c in self.clauses:
            if c[0].low == "delete":
                for r in references(c[1:]):
                    self.program.library.delete(r.name)

    def proc_delete(self) -> None:
        for r in references(self.options["data"]):
            self.program.library.delete(r.name)

    def proc_import(self) -> None:
        self.put(read_csv(self.program.spark, unquote(self.options["datafile"][0].text)), self.options["out"])

    def proc_export(self) -> None:
        write_csv(self.data(), unquote(self.options["outfile"][0].text))

    def proc_sql(self) -> None:
        for s in self.block[1:]:
            made = re.match(r"create\s+(?:table|view)\s+([\w.]+)\s+as\s+(.*)$", s, re.I | re.S)
            dropped = re.match(r"drop\s+(?:table|view)\s+([\w.]+)\s*$", s, re.I)
            if dropped:
                self.program.library.delete(dropped[1])
                continue
            text = made[2] if made else s
            if not re.match(r"\s*(select|with)\b", text, re.I):
                raise SyntaxProblem(f"PROC SQL: {s[:40]} isn't supported")
            df = self.program.spark.sql(self._with_views(text))
            if made:
                self.program.write(Reference(made[1]), df, self.step)
            else:
                self.program.printed.append(df)

    def _with_views(self, text: str) -> str:
        """SQL text in which datasets, one or two levels, are names of views."""
        library = self.program.library
        views = library.register_views()
        for lib in library.paths:
            for name in {m[1].lower() for m in re.finditer(rf"(?<![\w.]){lib}\.(\w+)", text, re.I)}:
                if (key := f"{lib}.{name}") not in views:
                    views[key] = f"{lib}__{name}"
                    library.get(key).createOrReplaceTempView(views[key])
        for key, view in views.items():
            name = rf"(?:work\.)?{re.escape(key[5:])}" if key.startswith("work.") else re.escape(key)
            if re.search(rf"(?<![\w.]){name}(?![\w.])", text, re.I):
                self.step.reads.append(key)
                if view != key.removeprefix("work."):
                    text = re.sub(rf"(?<![\w.]){name}(?![\w.])", view, text, flags=re.I)
                text = re.sub(rf"(?<![\w.])work\.{re.escape(key.partition('.')[2])}\b", view, text, flags=re.I) if key.startswith("work.") else text
        return re.sub(r"\^=|~=", "<>", text)


def compile_program(spark: SparkSession, source: str, datasets: dict[str, DataFrame] | None = None, include: Callable[[str], str] | None = None) -> Program:
    """Compile source over the given datasets."""
    program = Program(spark, include=include)
    for name, df in (datasets or {}).items():
        program.library.put(name, df)
    return program.run(source)

