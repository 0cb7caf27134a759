"""Programs of the step language end to end, and what they must refuse."""

import datetime

import pytest

from tallyloom.plans.lexer import SyntaxProblem, tokenize
from tallyloom.plans.macro import Expander, evaluate
from tallyloom.plans.program import compile_program

SETUP = """
%let heavy = 12;
%macro tidy(var); lowcase(strip(&var)) %mend;
"""
FREIGHT = """
%include 'setup';
libname port '/nowhere';
data port.crates;
  length dock $1;
  input crate dock $ weight cargo $ arrival : yymmdd10.;
datalines;
31 W 4.5 Tea 2024-05-01
32 N 19.0 Ore 2024-05-01
33 W 12.5 Salt 2024-05-03
34 E . Tea 2024-05-02
35 N 3.0 Rope 2024-05-03
36 W 12.0 Ore 2024-05-04
;
run;
proc sort data=port.crates out=queue; by dock descending weight; run;
data port.priced;
  set port.crates;
  cargo = %tidy(cargo);
  if dock eq 'N' then fee = weight * 3;
  else if dock = 'W' then fee = weight * 2 + 1;
  else fee = 7;
  due = fee + 0.5;
  if weight > &heavy then crane = 1; else crane = 0;
run;
proc freq data=port.priced; tables dock crane; run;
proc summary data=port.priced nway;
  class dock crane;
  var weight fee due;
  output out=books.docks(drop=_type_ _freq_) sum(weight)=tons sum(fee)=fees sum(due)=total;
run;
proc print data=books.docks; where total > 0; run;
"""


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_freight_program(spark):
    p = compile_program(spark, FREIGHT, include=lambda _: SETUP)
    priced = p.library.get("PORT.priced")
    assert rows(priced, "crate", "cargo", "fee", "due", "crane") == [(31.0, "tea", 10.0, 10.5, 0), (32.0, "ore", 57.0, 57.5, 1), (33.0, "salt", 26.0, 26.5, 1), (34.0, "tea", 7.0, 7.5, 0), (35.0, "rope", 9.0, 9.5, 0), (36.0, "ore", 25.0, 25.5, 0)]
    assert rows(p.library.get("books.docks"), "dock", "crane", "tons", "fees", "total")[1:] == [("N", 0, 3.0, 9.0, 9.5), ("N", 1, 19.0, 57.0, 57.5), ("W", 0, 16.5, 35.0, 36.0), ("W", 1, 12.5, 26.0, 26.5)]
    freq = {(r.table, r.level): r["count"] for r in p.printed[0].collect()}
    assert freq == {("dock", "E"): 1, ("dock", "N"): 2, ("dock", "W"): 3, ("crane", "0"): 4, ("crane", "1"): 2}
    assert p.printed[-1].count() == 5
    assert [int(r.crate) for r in p.library.get("queue").collect()] == [34, 32, 35, 33, 36, 31]
    nodes, edges = p.lineage()
    assert {(r.src, r.dst) for r in edges.collect()} >= {("1:data port.crates", "port.crates@1"), ("port.crates@1", "3:data port.priced"), ("port.priced@1", "5:proc summary")}
    assert nodes.count() == 10


def test_outputs_options_and_functions(spark):
    p = compile_program(
        spark,
        """
        data tools; input tool handle $ shelf $ grams; datalines;
        7 Awl Oak 150
        8 Plane Pine 900
        9 Rasp Pine .
        ;
        run;
        data heavy(keep=handle grams extra) light(rename=(grams=weight));
          set tools(where=(tool > 0));
          if shelf = 'Oak' then do; extra = grams * 2; mark = 'o'; end;
          if grams > 500 then output heavy; else output light;
        run;
        proc means data=tools; var grams; output out=stats mean=avg std=sd n=count; run;
        proc sql; create table pine as select handle, grams / 1000 as kg from tools where shelf ^= 'Oak' order by handle; quit;
        data marks; set tools; big = grams > 500; kind = put(tool, z4.); none = grams / 0; u = catx('-', handle, shelf); run;
        """,
    )
    assert rows(p.library.get("heavy"), "handle", "grams", "extra") == [("Plane", 900.0, None)]
    assert set(p.library.get("light").columns) == {"tool", "handle", "shelf", "weight", "extra", "mark"}
    assert [(r.avg, r["count"]) for r in p.library.get("stats").collect()] == [(525.0, 2)]
    assert [(r.handle, r.kg) for r in p.library.get("pine").collect()] == [("Plane", 0.9), ("Rasp", None)]
    assert rows(p.library.get("marks"), "tool", "big", "kind", "none", "u") == [(7.0, 0, "0007", None, "Awl-Oak"), (8.0, 1, "0008", None, "Plane-Pine"), (9.0, 0, "0009", None, "Rasp-Pine")]


@pytest.fixture
def small(spark):
    t = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (2, 3, None), (2, 4, 5.0)], "k int, i int, x double").repartition(3)
    return lambda source, **more: compile_program(spark, source, {"t": t, **more}).library.get


def test_descending_order_is_kept(small):
    get = small("""
        proc sort data=t out=s; by descending i; run;
        data d; set s; by descending i; c + 1; p = lag(i); if first.i; run;
        data e; set s; c + 1; p = lag(i); run;
        proc sort data=t out=u; by k descending i; run;
        data f; set u; by k descending i; if first.k; run;
        data g; set u; by k descending i; if last.k; n + 1; run;
    """)
    assert rows(get("e"), "i", "c", "p") == [(1, 4, 2), (2, 3, 3), (3, 2, 4), (4, 1, None)]
    assert rows(get("d"), "i", "c") == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert [r.i for r in get("f").orderBy("i").collect()] == [2, 4]
    assert [r.i for r in get("g").orderBy("i").collect()] == [1, 3]


def test_merge_pairs_rows_of_a_key(small, spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, s string")
    get = small("proc sort data=t out=s; by k descending i; run; data m; merge s a; by k; run; data w; merge s(in=p) a(in=q); by k; if p and not q; run;", a=a)
    assert rows(get("m"), "k", "i", "s") == [(1, 1, "b"), (1, 2, "a"), (2, 3, None), (2, 4, None), (3, None, "c")]
    assert rows(get("w"), "i") == [(3,), (4,)]


def test_missing_values_are_the_least(small):
    get = small("data m; set t; a = x = .; b = x < 6; c = x >= 6; d = not (x > 6); if x ne . then e = 1; if x <= 5; run; data n; set t(where=(x < 11)); run;")
    assert rows(get("m"), "i", "a", "b", "c", "d", "e") == [(3, 1, 1, 0, 1, None), (4, 0, 1, 0, 1, 1)]
    assert rows(get("n"), "i") == [(1,), (3,), (4,)]


def test_retained_values(small):
    get = small("""
        proc sort data=t out=s; by i; run;
        data m; set s; retain m 0 name 'none'; if x > m then do; m = x; name = cats('i', i); end; run;
        data per; set s; by k; retain top; if first.k then top = .; if x > top then top = x; if last.k; keep k top; run;
        data rich; set s; by k; total + x; if last.k then do; output; total = 0; end; keep k total; run;
    """)
    assert rows(get("m"), "i", "m", "name") == [(1, 10.0, "i1"), (2, 20.0, "i2"), (3, 20.0, "i2"), (4, 20.0, "i2")]
    assert rows(get("per"), "k", "top") == [(1, 20.0), (2, 5.0)]
    assert rows(get("rich"), "k", "total") == [(1, 30.0), (2, 5.0)]


def test_conditional_lag_is_a_queue(small):
    get = small("proc sort data=t out=s; by i; run; data l; set s; if i ne 2 then p = lag(i); q = dif(i); run;")
    assert rows(get("l"), "i", "p", "q") == [(1, None, None), (2, None, 1), (3, 1, 1), (4, 3, 1)]


def test_loops(small):
    get = small("""
        data w; set t; n = 0; y = i; do while (y < 20); y = y * 2; n + 1; end; run;
        data u; set t; y = i; do until (y >= 4); y = y + 3; end; run;
        data s; set t; total = 0; do j = 1 to i; total = total + j; end; do v = 5, i; total = total + v; end; run;
        data o; do i = 1 to 10 by 2 while (i < 8); if mod(i, 3) = 0 then output; end; run;
    """)
    assert rows(get("w"), "i", "y") == [(1, 32), (2, 32), (3, 24), (4, 32)]
    assert rows(get("u"), "i", "y") == [(1, 4), (2, 5), (3, 6), (4, 7)]
    assert rows(get("s"), "i", "total", "j") == [(1, 7, 2), (2, 10, 3), (3, 14, 4), (4, 19, 5)]
    assert rows(get("o"), "i") == [(3,)]


def test_arrays_row_numbers_and_stop(small):
    get = small("""
        proc sort data=t out=s; by i; run;
        data a; set s; array v{3} i k x; array w[2] $ p q; do j = 1 to dim(v); if missing(v{j}) then v{j} = -1; end; total = sum(of v{*}); w[1] = 'at'; w[2] = cats(w[1], i); drop j; run;
        data n; set s end=done; if _n_ = 1 then first = 'y'; number = _n_; if done then last = 1; run;
        data c; set s; if i = 3 then stop; run;
    """)
    assert rows(get("a"), "i", "x", "total", "p", "q") == [(1, 10.0, 12.0, "at", "at1"), (2, 20.0, 23.0, "at", "at2"), (3, -1.0, 4.0, "at", "at3"), (4, 5.0, 11.0, "at", "at4")]
    assert rows(get("n"), "i", "first", "number", "last") == [(1, "y", 1, None), (2, None, 2, None), (3, None, 3, None), (4, None, 4, 1)]
    assert rows(get("c"), "i") == [(1,), (2,)]


def test_values_become_macro_variables(small):
    get = small("""
        proc sort data=t out=s; by i; run;
        data _null_; set s; if x > 0 then call symputx('best', x); call symput('n', i); run;
        data after; set t; if x = &best; n = &n; run;
    """)
    assert rows(get("after"), "i", "n") == [(4, 4)]


def test_by_groups_merge_and_loops(spark):
    a = spark.createDataFrame([(1, "a", 5.0), (1, "b", 7.0), (2, "c", 1.0), (3, "d", None)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "one"), (3, "three"), (4, "four")], "k int, label string")
    p = compile_program(
        spark,
        """
        proc sort data=a; by k s; run;
        data run; set a; by k; if first.k then total = 0; total + v; if last.k; keep k total; run;
        data both; merge a(in=x) b(in=y); by k; if x and y; run;
        data grid; do i = 1 to 7 by 3; sq = i ** 2; output; end; run;
        data pick; set a; select (s); when ('a', 'b') g = 1; when ('c') g = 2; otherwise g = 9; end; drop v; run;
        data cut; set a b; if missing(v) then delete; run;
        proc sort data=a out=one nodupkey; by k; run;
        proc transpose data=a out=wide; by k; id s; var v; run;
        proc append base=all data=a; run;
        proc append base=all data=a; run;
        data lagged; set a; by k; p = lag(v); run;
        """,
        {"a": a, "b": b},
    )
    get = p.library.get
    assert rows(get("run"), "k", "total") == [(1, 12.0), (2, 1.0), (3, 0.0)]
    assert rows(get("both"), "k", "s", "label") == [(1, "a", "one"), (1, "b", "one"), (3, "d", "three")]
    assert rows(get("grid"), "i", "sq") == [(1, 1.0), (4, 16.0), (7, 49.0)]
    assert rows(get("pick"), "s", "g") == [("a", 1), ("b", 1), ("c", 2), ("d", 9)]
    assert get("cut").count() == 3 and get("one").count() == 3 and get("all").count() == 8
    assert rows(get("wide"), "k", "a", "b")[0] == (1, 5.0, 7.0)
    assert [(r.s, r.p) for r in get("lagged").orderBy("s").collect()] == [("a", None), ("b", 5.0), ("c", None), ("d", None)]
    assert p.library.versions("a") == 2


def test_macros():
    e = Expander()
    text = e.expand("""%let n = 3; %let lib = stag; %macro loop(p, q=7); %do i = 1 %to &n; x&i=&p+&q; %end; %if &n > 2 %then %do; big %end; %else small; %mend;
    &lib..data %loop(a) %loop(b, q=%eval(2*4)) %upcase(abc) %scan(a b c, 2) &&lib '&n'""")
    assert text.split() == "stag.data x1=a+7; x2=a+7; x3=a+7; big x1=b+8; x2=b+8; x3=b+8; big ABC b stag '&n'".split()
    assert [evaluate(x) for x in ("7/2", "2**3 - 1", "NA = NA", "a ne b", "1 & 0", "3 >= 3", "not 0")] == ["3", "7", "1", "1", "0", "1", "1"]
    assert evaluate("7/2", whole=False) == "3.5"
    with pytest.raises(SyntaxProblem):
        e.expand("%nosuch(1)")


def test_tokens_that_are_easy_to_confuse():
    kinds = [(t.kind, t.text) for t in tokenize("a = '01JAN2020'd; b = '01JAN2020:10:00:00'dt; c = 'it''s'; d ge 2 and x ne 1 /* no */; * gone;")]
    assert ("date", "'01JAN2020'd") in kinds and ("datetime", "'01JAN2020:10:00:00'dt") in kinds and ("string", "'it''s'") in kinds
    assert ("op", ">=") in kinds and ("op", "^=") in kinds and not any("no" in t or "gone" in t for _, t in kinds)


def test_dates_and_functions(spark):
    p = compile_program(spark, "data d; set one; a = '15JAN2020'd; b = intnx('month', a, 1); c = '01JAN2020:10:30:00'dt; n = intck('day', a, b); s = scan('x y z', 2); t = substr('hello', 2, 3); u = compress('a b'); w = -2 ** 2; z = 1 + 2 * 3 > 6 and not 0; run;", {"one": spark.range(1)})
    r = p.library.get("d").first()
    assert (r.a, r.b, r.n, r.s, r.t, r.u, r.w, r.z) == (datetime.date(2020, 1, 15), datetime.date(2020, 2, 1), 17, "y", "ell", "ab", -4.0, 1)
    assert r.c == datetime.datetime(2020, 1, 1, 10, 30)


@pytest.mark.parametrize("source", ["data x; set one; y = z; run;", "data x; set one; y = nosuch(1); run;", "proc nosuch data=one; run;", "data x; set one; y = (1; run;", "frob;", "%if 1"])
def test_refusals(spark, source):
    with pytest.raises((SyntaxProblem, KeyError)):
        compile_program(spark, source, {"one": spark.range(1)})


def test_missing_dataset(spark):
    with pytest.raises(KeyError):
        compile_program(spark, "data x; set nowhere; run;")
