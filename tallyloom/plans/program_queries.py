"""Programs of the step language over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .program import Program

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def program(key: str, source: str, result: str, sql: str, rounded: dict[str, int] | None = None) -> None:
    """Compile source with the library tpch at the tables' folder; the query is dataset `result` (or listing number)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Program(spark)
        p.library.paths["tpch"] = sf_dir
        p.run(source)
        df = p.printed[int(result)] if result.isdigit() else p.library.get(result)
        return df.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[key] = run
    ORACLE[key] = sql


program(
    "l03_program_etl",
    """
    %let high = 200000;
    proc sql;
      create table raw as select o_orderkey, cast(o_orderdate as date) as date, r_name, o_orderpriority as product, o_totalprice as amount
      from tpch.orders join tpch.customer on o_custkey = c_custkey join tpch.nation on c_nationkey = n_nationkey join tpch.region on n_regionkey = r_regionkey;
    quit;
    data clean;
      set raw;
      length region $2;
      if r_name eq 'EUROPE' then region = 'EU'; else if r_name eq 'AMERICA' then region = 'NA'; else region = 'AS';
      product = upcase(strip(product));
      select (region); when ('NA') tax = amount * 0.1; when ('EU') tax = amount * 0.2; otherwise tax = amount * 0.05; end;
      total_amount = amount + tax;
      if total_amount > &high then high_value_flag = 1; else high_value_flag = 0;
      drop r_name;
    run;
    proc summary data=clean nway; class region high_value_flag; var amount tax; output out=sums(drop=_type_) sum(amount)=sales sum(tax)=tax; run;
    """,
    "sums",
    "WITH x AS (SELECT CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'AMERICA' THEN 'NA' ELSE 'AS' END AS region, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), y AS (SELECT *, amount * CASE region WHEN 'NA' THEN 0.1 WHEN 'EU' THEN 0.2 ELSE 0.05 END AS tax FROM x) SELECT region, CAST(amount + tax > 200000 AS INT) AS high_value_flag, count(*) AS \"_FREQ_\", round(sum(amount), 4) AS sales, round(sum(tax), 4) AS tax FROM y GROUP BY 1, 2",
    {"sales": 4, "tax": 4},
)
program(
    "l04_program_by_groups",
    """
    proc sort data=tpch.orders(keep=o_custkey o_orderdate o_orderkey o_totalprice) out=o; by o_custkey o_orderdate o_orderkey; run;
    data per(keep=o_custkey n total);
      set o; by o_custkey;
      if first.o_custkey then total = 0;
      if first.o_custkey then n = 0;
      total + o_totalprice;
      n + 1;
      if last.o_custkey;
    run;
    """,
    "per",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey",
    {"total": 2},
)
program(
    "l05_program_merge",
    """
    proc sql;
      create table spent as select o_custkey as c_custkey, round(sum(o_totalprice), 2) as spent from tpch.orders where o_orderstatus ^= 'P' group by o_custkey;
    quit;
    data both(keep=c_custkey c_name spent);
      merge tpch.customer(in=a) spent(in=b); by c_custkey;
      if a and b;
    run;
    """,
    "both",
    "SELECT c_custkey, c_name, spent FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON c_custkey = o_custkey",
)
program(
    "l06_program_procedures",
    """
    %macro stats(v); proc means data=tpch.lineitem(where=(l_quantity > 10)) nway; class l_returnflag; var &v; output out=m_&v(drop=_type_ _freq_) mean=avg std=sd n=n; run; %mend;
    %do i = 1 %to 1; %stats(l_tax) %end;
    """,
    "m_l_tax",
    "SELECT l_returnflag, round(avg(l_tax), 6) AS avg, round(stddev_samp(l_tax), 6) AS sd, count(l_tax) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    {"avg": 6, "sd": 6},
)
program(
    "l07_program_sql",
    "proc sql; select n_name, count(*) as n from tpch.supplier, tpch.nation where s_nationkey = n_nationkey and s_acctbal > 0 group by n_name having count(*) >= 1; quit;",
    "0",
    "SELECT n_name, count(*) AS n FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name",
)
program(
    "l08_program_freq",
    "proc freq data=tpch.orders; tables o_orderstatus * o_orderpriority; run;",
    "0",
    "SELECT o_orderstatus, o_orderpriority, n AS count, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS row_percent, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS col_percent FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)",
    {"percent": 6, "row_percent": 6, "col_percent": 6},
)
_BY_CUSTOMER = "proc sort data=tpch.orders(keep=o_custkey o_orderdate o_orderkey o_totalprice o_orderstatus) out=o; by o_custkey o_orderdate o_orderkey; run;"
_LINE = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
program(
    "p16_do_until",
    "data d; set tpch.orders(keep=o_orderkey o_totalprice); x = o_totalprice; turns = 0; do until (x >= 1000000); x = x * 2; turns = turns + 1; end; keep o_orderkey turns; run;",
    "d",
    "SELECT o_orderkey, CAST(list_min(list_filter(range(1, 60), lambda t: o_totalprice * pow(2, t) >= 1000000)) AS DOUBLE) AS turns FROM orders",
)
program(
    "p18_array",
    "data d; set tpch.lineitem(keep=l_orderkey l_linenumber l_quantity l_discount l_tax); array v{*} l_quantity l_discount l_tax; do i = 1 to dim(v); v{i} = v{i} * 2; end; drop i; run;",
    "d",
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, l_discount * 2 AS l_discount, l_tax * 2 AS l_tax FROM lineitem",
)
program(
    "l09_descending_order",
    "proc sort data=tpch.orders(keep=o_custkey o_orderdate o_orderkey o_totalprice) out=o; by o_custkey descending o_orderdate descending o_orderkey; run; data d(drop=o_orderdate); set o; by o_custkey; n + 1; before = lag(o_orderkey); if first.o_custkey then n = 0; if last.o_custkey; run;",
    "d",
    "SELECT o_custkey, o_orderkey, o_totalprice, CAST(n - 1 AS DOUBLE) AS n, CAST(before AS DOUBLE) AS before FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, lag(o_orderkey) OVER w AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) WHERE r = 1",
)
program(
    "l10_merge_pairs",
    """
    proc sort data=tpch.customer(keep=c_nationkey c_custkey rename=(c_nationkey=k)) out=c; by k descending c_custkey; run;
    proc sort data=tpch.supplier(keep=s_nationkey s_suppkey rename=(s_nationkey=k)) out=s; by k s_suppkey; run;
    data m; merge c s; by k; run;
    """,
    "m",
    "WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), z AS (SELECT k, max(n) AS m FROM (SELECT k, n FROM a UNION ALL SELECT k, n FROM b) GROUP BY k), y AS (SELECT k, unnest(range(1, m + 1)) AS j FROM z) SELECT y.k, c_custkey, s_suppkey FROM y LEFT JOIN a ON a.k = y.k AND a.i = least(y.j, a.n) LEFT JOIN b ON b.k = y.k AND b.i = least(y.j, b.n)",
)
program(
    "l11_retain",
    _BY_CUSTOMER + " data r(keep=o_orderkey top); set o; by o_custkey; retain top; if first.o_custkey then top = .; if o_totalprice > top then top = o_totalprice; run;",
    "r",
    f"SELECT o_orderkey, max(o_totalprice) OVER ({_LINE}) AS top FROM orders",
)
program(
    "l12_conditional_lag",
    _BY_CUSTOMER + " data g(keep=o_orderkey p); set o; by o_custkey; if o_orderstatus = 'F' then p = lag(o_totalprice); run;",
    "g",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lag(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) END AS p FROM orders",
)
program(
    "l13_macro_variable_from_data",
    "proc sql; create table m as select max(o_totalprice) as top from tpch.orders; quit; data _null_; set m; call symputx('top', top); run; data best; set tpch.orders(keep=o_orderkey o_totalprice); if o_totalprice >= &top; run;",
    "best",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)",
)
program(
    "l14_missing_values",
    "proc sql; create table c as select c_custkey, n from tpch.customer left join (select o_custkey, count(*) as n from tpch.orders group by o_custkey) as o on c_custkey = o_custkey; quit; data d; set c; none = n = .; few = n < 9; many = not (n <= 12); run;",
    "d",
    "SELECT c_custkey, n, CAST(n IS NULL AS INT) AS none, CAST(coalesce(n < 9, true) AS INT) AS few, CAST(coalesce(n > 12, false) AS INT) AS many FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
program(
    "l15_row_numbers",
    "proc sort data=tpch.customer(keep=c_custkey c_acctbal) out=c; by descending c_acctbal c_custkey; run; data d(keep=c_custkey number end); set c end=done; number = _n_; end = done; run;",
    "d",
    "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS DOUBLE) AS number, CASE WHEN row_number() OVER (ORDER BY c_acctbal, c_custkey DESC) = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS \"end\" FROM customer",
)
program(
    "l16_select_in_program",
    "data d(keep=n_nationkey code zone big); set tpch.nation; select (n_regionkey); when (0, 4) code = 'A'; when (1) code = 'B'; otherwise code = 'Z'; end; if n_nationkey > 12 then do; big = 1; zone = cats(code, n_regionkey); end; else big = 0; where n_nationkey ne 3; run;",
    "d",
    "SELECT n_nationkey, code, CAST(n_nationkey > 12 AS INT) AS big, CASE WHEN n_nationkey > 12 THEN code || n_regionkey END AS zone FROM (SELECT *, CASE WHEN n_regionkey IN (0, 4) THEN 'A' WHEN n_regionkey = 1 THEN 'B' ELSE 'Z' END AS code FROM nation) WHERE n_nationkey <> 3",
)
