"""Step-language operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import panel as P
from ..operators import steps as O
from ..sources import tables as T
from ..sources.cut import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(key: str, sql: str | None):
    def add(build: Callable[[_Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(_Tables(spark, sf_dir))
        if sql:
            ORACLE[key] = sql
        return build

    return add


TRANSACTIONS = [
    ("k-90", "Po", 12.5, "gauge", "2021-03-02"),
    ("k-91", "Ti", 0.0, "valve", "2021-03-02"),
    ("k-92", "Po", 844.0, "hose", "2021-02-28"),
    ("k-93", "Ma", 31.75, "valve", "2020-12-31"),
]
_VALUES = ", ".join(f"('{i}', '{g}', {a!r}::DOUBLE, '{p}', DATE '{d}')" for i, g, a, p, d in TRANSACTIONS)


def transactions(spark: SparkSession) -> DataFrame:
    return T.datalines(spark, TRANSACTIONS, "transaction_id string, region string, amount double, product string, date string", {"date": "yymmdd10."}, {"region": 2})


# --- sources -----------------------------------------------------------------
@query("s01_datalines", f"SELECT * FROM (VALUES {_VALUES}) AS t(transaction_id, region, amount, product, date)")
def _(t):
    return transactions(t.spark)


@query("s02_informats", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS d, substring(o_orderpriority, 1, 2) AS p FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.input_(F.date_format("o_orderdate", "yyyy-MM-dd"), "yymmdd10.").alias("d"), S.substr(F.col("o_orderpriority"), 1, 2).alias("p"))


@query("s03_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = new_folder(t.spark, "csv")
    T.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return T.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double", drop_malformed=True)


@query("s05_library_scan", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    lib = T.Library(t.spark)
    lib.paths["tpch"] = t.sf_dir
    return lib.get("TPCH.Customer").join(lib.get("tpch.nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("s07_sql_text", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def _(t):
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderpriority HAVING count(*) > 10", orders=t.orders)


@query("s12_parquet_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = new_folder(t.spark, "parquet")
    T.write_parquet(t.nation, path)
    return t.spark.read.parquet(path)


@query("s17_print", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC")
def _(t):
    return t.orders.where("o_totalprice > 300000").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"))


@query("s18_empty_sentinel", "SELECT -999 AS o_orderkey, 999.0::DOUBLE AS o_totalprice WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 0")
def _(t):
    return O.or_sentinel(t.orders.where("o_totalprice < 0").select("o_orderkey", "o_totalprice"), o_orderkey=-999, o_totalprice=999.0)


# --- projection and row logic ------------------------------------------------
@query("p02_set_concatenate", "SELECT c_name AS name, c_acctbal AS bal, 'C' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'S' FROM supplier")
def _(t):
    return O.stack(O.rename(O.keep(t.customer, "C_NAME", "c_acctbal"), c_name="name", C_ACCTBAL="bal").withColumn("kind", F.lit("C")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.lit("S").alias("kind")))


@query("p03_dataset_options", "SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _(t):
    return O.rename(O.keep(t.customer.where("c_acctbal > 5000"), "c_custkey", "c_acctbal", "no_such"), c_custkey="id")


@query("p04_assignment", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem")
def _(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"), F.round(net * (1 + F.col("l_tax")), 6).alias("gross"))


@query("p05_if_then_else", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("band"))


@query("p06_do_block", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 0.1, 4) END AS fee FROM orders")
def _(t):
    done = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(done, 1).otherwise(0).alias("done"), F.when(done, F.round(F.col("o_totalprice") * 0.1, 4)).alias("fee"))


@query("p07_subsetting_if", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(t):
    return t.lineitem.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@query("p08_where", "SELECT event_id, value FROM events WHERE event_type <> 'view' AND value BETWEEN 10 AND 20")
def _(t):
    return t.events.where((F.col("event_type") != "view") & F.col("value").between(10, 20)).select("event_id", "value")


@query("p09_keep_drop_rename", "SELECT s_suppkey AS supplier_id, s_name FROM supplier")
def _(t):
    return O.rename(O.drop(t.supplier, "S_NATIONKEY", "s_acctbal"), s_suppkey="supplier_id")


@query("p10_length", "SELECT p_partkey, substring(p_name, 1, 8) AS p_name FROM part")
def _(t):
    return O.label(t.part.select("p_partkey", F.substring("p_name", 1, 8).alias("p_name")), p_name={"label": "Part name", "length": 8})


@query("p11_retain_sum", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def _(t):
    return O.retain_sum(t.orders, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], "running").select("o_orderkey", "o_custkey", F.round("running", 2).alias("running"))


@query("p12_first_last", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS INT) AS first_, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS INT) AS last_ FROM orders")
def _(t):
    return O.first_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "first_", "last_")


@query("p13_output_delete", "SELECT o_orderkey, 'big' AS kind FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_orderkey, 'done' FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return O.stack(t.orders.where("o_totalprice > 250000").select("o_orderkey", F.lit("big").alias("kind")), t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("kind")))


@query("p15_do_loop", "SELECT r_regionkey, CAST(i AS INT) AS i, CAST(r_regionkey * i AS INT) AS x FROM region, unnest(range(1, 8, 2)) AS t(i)")
def _(t):
    return O.do_loop(t.region.select("r_regionkey"), "i", 1, 7, 2).withColumn("x", F.col("r_regionkey") * F.col("i"))


@query("p17_select_when", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 3 THEN 'EU' ELSE 'XX' END AS code FROM nation")
def _(t):
    k = F.col("n_regionkey")
    return t.nation.select("n_nationkey", F.when(k == 0, "AF").when(k == 1, "AM").when(k == 3, "EU").otherwise("XX").alias("code"))


@query("p19_firstobs", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n >= 2")
def _(t):
    return t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n >= 2").select("event_id", "user_id")


@query("p20_last_row", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("p21_dropna", "SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(t):
    return t.documents.dropna(subset=["lang", "source"]).select("doc_id", "lang", "source")


@query("p22_numeric_columns", "SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(t):
    return t.lineitem.select(O.numeric_columns(t.lineitem, ["L_ORDERKEY"]))


@query("p23_to_character", "SELECT s_name, CAST(format('{:.2f}', CAST(s_suppkey AS DOUBLE)) AS VARCHAR) AS s_suppkey, format('{:.2f}', CAST(s_nationkey AS DOUBLE)) AS s_nationkey, format('{:.2f}', s_acctbal) AS s_acctbal FROM supplier")
def _(t):
    return O.to_character(t.supplier, "%.2f")


@query("p25_unpivot", "SELECT l_orderkey, l_linenumber, 'tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem")
def _(t):
    return O.unpivot(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount")), ["l_orderkey", "l_linenumber"], ["tax", "discount"])


@query("p26_row_id", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("id"))


# --- joins -------------------------------------------------------------------
# days with orders, and days with shipments: some of either have none of the other
_cust = "(SELECT CAST(o_orderdate AS DATE) AS k, count(*) AS bal FROM orders GROUP BY 1)"
_ords = "(SELECT CAST(l_shipdate AS DATE) AS k, max(l_quantity) AS top, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS bal FROM lineitem GROUP BY 1)"


def _sides(t):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("k")).agg(F.count("*").alias("bal"))
    b = t.lineitem.groupBy(F.to_date("l_shipdate").alias("k")).agg(F.max("l_quantity").alias("top"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("bal"))
    return a, b


@query("j01_merge", f"SELECT coalesce(a.k, b.k) AS k, coalesce(b.bal, a.bal) AS bal, b.top, CAST(a.k IS NOT NULL AS INT) AS in_left, CAST(b.k IS NOT NULL AS INT) AS in_right FROM {_cust} a FULL JOIN {_ords} b ON a.k = b.k")
def _(t):
    return O.merge(*_sides(t), ["k"])


@query("j02_merge_in_flags", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS kind FROM {_cust} a FULL JOIN {_ords} b ON a.k = b.k) GROUP BY kind")
def _(t):
    m = O.merge(*_sides(t), ["k"])
    return m.groupBy(F.when(F.col("in_left") == 0, "right").when(F.col("in_right") == 0, "left").otherwise("both").alias("kind")).agg(F.count("*").alias("n"))


@query("j01_merge_many_to_many", "WITH a AS (SELECT c_nationkey AS k, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), z AS (SELECT k, max(n) AS m FROM (SELECT k, n FROM a UNION ALL SELECT k, n FROM b) GROUP BY k), y AS (SELECT k, unnest(range(1, m + 1)) AS j FROM z) SELECT y.k, c, s FROM y LEFT JOIN a ON a.k = y.k AND a.i = least(y.j, a.n) LEFT JOIN b ON b.k = y.k AND b.i = least(y.j, b.n)")
def _(t):
    return O.merge(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c")), t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s")), ["k"], many=True).select("k", "c", "s")


@query("j03_update", f"SELECT coalesce(a.k, b.k) AS k, coalesce(b.bal, a.bal) AS bal FROM {_cust} a FULL JOIN (SELECT k, bal FROM {_ords}) b ON a.k = b.k")
def _(t):
    a, b = _sides(t)
    return O.update(a, b.select("k", "bal"), ["k"])


@query("j04_modify", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(t):
    lib = T.Library(t.spark)
    lib.put("sup", t.supplier.select("s_suppkey", "s_acctbal"))
    lib.put("sup", lib.get("sup").withColumn("s_acctbal", F.greatest("s_acctbal", F.lit(0.0))))
    return lib.get("work.SUP")


@query("j06_inner_join", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("j07_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("j08_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full")


@query("j09_join_with_total", "SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority")
def _(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    return t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s")).crossJoin(F.broadcast(total)).select("o_orderpriority", F.round(F.col("s") / F.col("total"), 6).alias("share"))


@query("j10_one_group_many_aggs", "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o FROM orders GROUP BY 1, 2")
def _(t):
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(part("F").alias("f"), part("O").alias("o"))


@query("j11_hash_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return O.hash_lookup(t.lineitem, part, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query("j12_self_pairs", "SELECT x.event_type AS a1, y.event_type AS a2, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) x JOIN (SELECT DISTINCT user_id, event_type FROM events) y USING (user_id) GROUP BY 1, 2")
def _(t):
    d = t.events.select(F.col("user_id").alias("date"), F.col("event_type").alias("asset"), F.lit(0.0).alias("r")).distinct()
    return P.pairs(d).groupBy("a1", "a2").agg(F.count("*").alias("n"))


@query("j13_semi_anti", "SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS INT) AS buys FROM customer")
def _(t):
    has = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    no = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return has.select("c_custkey", F.lit(1).alias("buys")).unionByName(no.select("c_custkey", F.lit(0).alias("buys")))


# --- aggregation -------------------------------------------------------------
@query("a01_means", "SELECT count(l_quantity) AS l_quantity_n, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem")
def _(t):
    m = O.means(t.lineitem, ["l_quantity"])
    return m.withColumns({c: F.round(c, 6) for c in ("l_quantity_mean", "l_quantity_std")})


@query("a02_summary_nway", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_tax), 6) AS l_tax_mean FROM lineitem GROUP BY 1, 2")
def _(t):
    m = O.means(t.lineitem, ["l_quantity", "l_tax"], ["sum", "mean"], ["l_returnflag", "l_linestatus"])
    return m.select("l_returnflag", "l_linestatus", F.round("l_quantity_sum", 2).alias("l_quantity_sum"), F.round("l_tax_mean", 6).alias("l_tax_mean"))


@query("a03_summary_types", 'SELECT l_returnflag, l_linestatus, CAST(3 - grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS "_TYPE_", count(*) AS "_FREQ_", round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)')
def _(t):
    return O.summary(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": "qty"}).withColumn("qty", F.round("qty", 2))


_fr = "SELECT '{0}' AS \"table\", {0} AS level, count(*) AS n FROM orders GROUP BY 2"


@query("a04_freq_one_way", f'SELECT "table", level, n AS count, round(100.0 * n / sum(n) OVER (PARTITION BY "table"), 6) AS percent, CAST(sum(n) OVER o AS BIGINT) AS cum_count, round(100.0 * sum(n) OVER o / sum(n) OVER (PARTITION BY "table"), 6) AS cum_percent FROM ({_fr.format("o_orderstatus")} UNION ALL {_fr.format("o_orderpriority")}) WINDOW o AS (PARTITION BY "table" ORDER BY level)')
def _(t):
    return O.freq(t.orders, "o_orderstatus", "o_orderpriority").withColumns({c: F.round(c, 6) for c in ("percent", "cum_percent")})


@query("a05_freq_two_way", "SELECT o_orderstatus, o_orderpriority, n AS count, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS row_percent, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS col_percent FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)")
def _(t):
    return O.crosstab(t.orders, "o_orderstatus", "o_orderpriority").withColumns({c: F.round(c, 6) for c in ("percent", "row_percent", "col_percent")})


@query("a06_univariate", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95, round(skewness(value), 6) AS skew FROM events GROUP BY event_type")
def _(t):
    from ..functions.moments import skewness

    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.05), 6).alias("p5"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(skewness(v, "sample"), 6).alias("skew"))


@query("a06_corr_reg", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS corr, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr(y, x), 6).alias("corr"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("a07_normalize", "SELECT o_orderkey, round(o_totalprice / (sum(o_totalprice) OVER () / 1000), 6) AS share FROM orders")
def _(t):
    return O.normalize(t.orders, "o_totalprice", k=1000).select("o_orderkey", F.round("share", 6).alias("share"))


@query("a08_normalize_by", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def _(t):
    return O.normalize(t.orders, "o_totalprice", ["o_custkey"]).select("o_orderkey", F.round("share", 6).alias("share"))


@query("a09_missing_counts", "SELECT count(lang) AS n, count(*) - count(lang) AS missing FROM documents")
def _(t):
    return t.documents.agg(F.count("lang").alias("n"), F.sum(F.col("lang").isNull().cast("long")).alias("missing"))


@query("a11_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY 1")
def _(t):
    # one histogram for all three
    q = t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "med", "q3"))])


@query("a12_approximate_percentile", None)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("med"))


@query("a13_spread", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS var, round(stddev_pop(value), 6) AS sdp FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_samp("value"), 6).alias("var"), F.round(F.stddev_pop("value"), 6).alias("sdp"))


@query("a16_product", "SELECT p_brand, round(exp(sum(ln(1 + p_size / 1000.0))), 6) AS growth FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.round(F.exp(F.sum(F.log(1 + F.col("p_size") / 1000.0))), 6).alias("growth"))


@query("a18_covariance", "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_discount, l_tax), 6) AS corr FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.corr("l_discount", "l_tax"), 6).alias("corr"))


@query("a20_conditional_mean", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 4) AS hi, round(avg(CAST(l_quantity < 10 AS INT)), 6) AS small FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 4).alias("hi"), F.round(F.avg((F.col("l_quantity") < 10).cast("int")), 6).alias("small"))


@query("a22_group_having_distinct", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) >= 5")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"), F.count("*").alias("n")).where("n >= 5").drop("n")


@query("a23_abs_difference", "SELECT round(sum(abs(a.q - b.q)), 4) AS total FROM (SELECT l_linenumber AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_linenumber AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (k)")
def _(t):
    side = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return t.lineitem.groupBy("l_linenumber").agg(side("A").alias("a"), side("R").alias("b")).agg(F.round(F.sum(F.abs(F.col("a") - F.col("b"))), 4).alias("total"))


# --- windows -----------------------------------------------------------------
_daily = "(SELECT event_type AS asset, CAST(ts AS DATE) AS date, avg(value) AS price FROM events GROUP BY 1, 2)"


@query("w01_lag_return_daily", f"SELECT * FROM (SELECT asset, date, round(price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1, 6) AS r FROM {_daily}) WHERE r IS NOT NULL")
def _(t):
    return P.returns(P.daily_prices(t.events)).withColumn("r", F.round("r", 6))


@query("w03_previous_row", f"SELECT asset, date, round(max(price) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 6) AS previous FROM {_daily}")
def _(t):
    return P.daily_prices(t.events).select("asset", "date", F.round(F.lag("price").over(P.by_time()), 6).alias("previous"))


@query("w05_running_sum_max", f"SELECT asset, date, round(sum(price) OVER o, 6) AS total, round(max(price) OVER o, 6) AS peak FROM {_daily} WINDOW o AS (PARTITION BY asset ORDER BY date)")
def _(t):
    return P.daily_prices(t.events).select("asset", "date", F.round(F.sum("price").over(P.so_far()), 6).alias("total"), F.round(F.max("price").over(P.so_far()), 6).alias("peak"))


@query("w07_running_within_month", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey", F.trunc("o_orderdate", "MM")).orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@query("w08_year_to_date_product", "SELECT asset, date, round(exp(sum(ln(1 + r)) OVER (PARTITION BY asset, year(date) ORDER BY date)) - 1, 6) AS ytd FROM (SELECT * FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM (SELECT l_returnflag AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)) WHERE r IS NOT NULL)")
def _(t):
    w = Window.partitionBy("asset", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return P.returns(P.monthly_prices(t.lineitem)).where("asset <> 'MKT'").select("asset", "date", F.round(F.exp(F.sum(F.log(1 + F.col("r"))).over(w)) - 1, 6).alias("ytd"))


@query("w09_first_last_pick", f"SELECT asset, round(arg_min(price, date), 6) AS first, round(arg_max(price, date), 6) AS last FROM {_daily} GROUP BY asset")
def _(t):
    return P.daily_prices(t.events).groupBy("asset").agg(F.round(F.min_by("price", "date"), 6).alias("first"), F.round(F.max_by("price", "date"), 6).alias("last"))


@query("w10_full_frame", f"SELECT asset, date, round(last_value(price) OVER o, 6) AS last, count(*) OVER o AS n FROM {_daily} WINDOW o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    w = P.by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return P.daily_prices(t.events).select("asset", "date", F.round(F.last("price").over(w), 6).alias("last"), F.count("*").over(w).alias("n"))


@query("w11_running_annualized", f"SELECT asset, date, round(exp(52 * avg(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) - 1, 6) AS annual FROM (SELECT * FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM {_daily}) WHERE r IS NOT NULL)")
def _(t):
    return P.returns(P.daily_prices(t.events)).select("asset", "date", F.round(F.exp(52 * F.avg(F.log(1 + F.col("r"))).over(P.so_far())) - 1, 6).alias("annual"))


@query("w12_autocorrelation_daily", f"SELECT asset, {', '.join(f'round(corr(r, l{k}), 6) AS rho{k}' for k in (1, 2, 3))} FROM (SELECT asset, r, {', '.join(f'lag(r, {k}) OVER (PARTITION BY asset ORDER BY date) AS l{k}' for k in (1, 2, 3))} FROM (SELECT * FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM {_daily}) WHERE r IS NOT NULL)) GROUP BY asset")
def _(t):
    d = P.returns(P.daily_prices(t.events))
    return d.select("asset", "r", *[F.lag("r", k).over(P.by_time()).alias(f"l{k}") for k in (1, 2, 3)]).groupBy("asset").agg(*[F.round(F.corr("r", f"l{k}"), 6).alias(f"rho{k}") for k in (1, 2, 3)])


@query("w13_lag_dif", "SELECT event_id, lag(value) OVER o AS lag1, round(value - lag(value) OVER o, 6) AS dif1 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", last.alias("lag1"), F.round(F.col("value") - last, 6).alias("dif1"))


# --- sorting, sets, reshaping --------------------------------------------------
@query("o01_sort", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC")
def _(t):
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal").orderBy(F.asc_nulls_first("c_nationkey"), F.desc("c_acctbal"))


@query("o02_sort_nodupkey", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t):
    return O.sort_nodupkey(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("o03_top_k", "SELECT l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice, 1) AS price, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 10")
def _(t):
    return O.top_k(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 10).select("l_returnflag", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 1).alias("price"), "rank")


@query("o04_latest_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_totalprice")


@query("o06_append", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def _(t):
    lib = T.Library(t.spark)
    lib.put("base", t.supplier.select(F.col("s_name").alias("name")))
    lib.put("base", O.stack(lib.get("base"), t.customer.select(F.col("c_name").alias("name"))))
    return lib.get("base")


@query("o07_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("o08_intersect_except", "(SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier))")
def _(t):
    c, s, n = (x.select(F.col(k).alias("k")) for x, k in ((t.customer, "c_nationkey"), (t.supplier, "s_nationkey"), (t.nation, "n_nationkey")))
    return c.intersect(s).select(F.lit("both").alias("kind"), "k").unionByName(n.subtract(s).select(F.lit("only").alias("kind"), "k"))


@query("o09_transpose", "SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"F\", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS \"O\", round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS \"P\" FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return O.transpose(d, ["year"], "o_orderstatus", "total", ["F", "O", "P"])


@query("o10_pivot_year_month", f"SELECT CAST(year(o_orderdate) AS INT) AS year, {', '.join(f'count(*) FILTER (WHERE month(o_orderdate) = {m}) AS m{m}' for m in range(1, 13))} FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    return O.transpose(d, ["year"], "m", "n", [f"m{m}" for m in range(1, 13)]).fillna(0)


@query("o11_compare", "SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.v - b.v) > 1e-8) AS v_differs, round(coalesce(sum(abs(a.v - b.v)), 0), 4) AS v_abs_diff FROM (SELECT CAST(o_orderdate AS DATE) AS k, count(*)::DOUBLE AS v FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS k, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1) b ON a.k = b.k")
def _(t):
    a, b = (d.groupBy(F.to_date(day).alias("k")).agg(F.count("*").cast("double").alias("v")) for d, day in ((t.orders, "o_orderdate"), (t.lineitem, "l_shipdate")))
    return O.compare(a, b, ["k"], ["v"]).withColumn("v_abs_diff", F.round("v_abs_diff", 4))


@query("proc_contents", None)
def _(t):
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in t.lineitem.schema], "name string, type string, nullable boolean")


# --- scalar functions ----------------------------------------------------------
_id = ("l_orderkey", "l_linenumber")


@query("f01_row_statistics", "SELECT l_orderkey, l_linenumber, round(a + b + c, 6) AS s, round((a + b + c) / 3, 6) AS m, least(a, b, c) AS lo, greatest(a, b, c) AS hi, round(greatest(a, b, c) - least(a, b, c), 6) AS rng, CAST(CASE WHEN d IS NULL THEN 3 ELSE 4 END AS INT) AS n, CAST(CASE WHEN d IS NULL THEN 1 ELSE 0 END AS INT) AS nm, round(list_stddev_samp([a, b, c]), 6) AS sd, round(list_var_samp([a, b, c]), 6) AS v FROM (SELECT *, l_quantity AS a, l_discount AS b, l_tax AS c, CASE WHEN l_quantity > 25 THEN l_tax END AS d FROM lineitem)")
def _(t):
    _q, _d, _x = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    d = F.when(_q > 25, _x)
    return t.lineitem.select(*_id, F.round(S.sum_of(_q, _d, _x), 6).alias("s"), F.round(S.mean_of(_q, _d, _x), 6).alias("m"), S.min_of(_q, _d, _x).alias("lo"), S.max_of(_q, _d, _x).alias("hi"), F.round(S.range_of(_q, _d, _x), 6).alias("rng"), S.n_of(_q, _d, _x, d).alias("n"), S.nmiss_of(_q, _d, _x, d).alias("nm"), F.round(S.std_of(_q, _d, _x), 6).alias("sd"), F.round(S.var_of(_q, _d, _x), 6).alias("v"))


@query("f07_numeric", "SELECT c_custkey, abs(b) AS a, round(sqrt(abs(b)), 6) AS sq, round(exp(b / 10000), 6) AS ex, round(ln(abs(b) + 1), 6) AS lg, round(log10(abs(b) + 1), 6) AS lg10, round(sin(b), 6) AS si, round(cos(b), 6) AS co, CAST(trunc(b) AS DOUBLE) AS tr, round(round(b / 50) * 50, 4) AS r50, CAST(floor(b) AS DOUBLE) AS fl, CAST(ceil(b) AS DOUBLE) AS ce, round(b % 7, 6) AS md, CAST(sign(b) AS DOUBLE) AS sg, round(pow(b / 1000, 2), 6) AS pw FROM (SELECT c_custkey, c_acctbal AS b FROM customer)")
def _(t):
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(v).alias("a"), F.round(F.sqrt(F.abs(v)), 6).alias("sq"), F.round(F.exp(v / 10000), 6).alias("ex"), F.round(F.log(F.abs(v) + 1), 6).alias("lg"), F.round(F.log10(F.abs(v) + 1), 6).alias("lg10"), F.round(F.sin(v), 6).alias("si"), F.round(F.cos(v), 6).alias("co"), S.int_(v).alias("tr"), F.round(S.round_to(v, 50.0), 4).alias("r50"), F.floor(v).cast("double").alias("fl"), F.ceil(v).cast("double").alias("ce"), F.round(S.mod(v, 7), 6).alias("md"), F.signum(v).alias("sg"), F.round(F.pow(v / 1000, F.lit(2)), 6).alias("pw"))


@query("f21_text", "SELECT p_partkey, substring(p_name, 2, 4) AS sub, split_part(trim(p_name), ' ', 2) AS w2, rtrim(p_name || '  ') AS tr, lpad(rtrim(p_name), 30, ' ') AS rt, upper(p_name) AS up, lower(p_type) AS lo, replace(p_name, ' ', '') AS co, translate(p_name, 'ae', '') AS co2, replace(p_name, 'e', 'EE') AS tw, translate(p_name, 'abc', 'xyz') AS tl, reverse(p_name) AS rv, CAST(length(rtrim(p_name)) AS INT) AS ln, CAST(instr(p_name, 'e') AS INT) AS ix, CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INT) AS ct, CAST(len(string_split_regex(trim(p_name), '[ ,]+')) AS INT) AS cw FROM part")
def _(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", S.substr(n, 2, 4).alias("sub"), S.scan(n, 2).alias("w2"), S.trim(F.concat(n, F.lit("  "))).alias("tr"), S.right(n, 30).alias("rt"), F.upper(n).alias("up"), F.lower("p_type").alias("lo"), S.compress(n).alias("co"), S.compress(n, "ae").alias("co2"), S.tranwrd(n, "e", "EE").alias("tw"), S.translate(n, "xyz", "abc").alias("tl"), F.reverse(n).alias("rv"), S.length(n).alias("ln"), S.index(n, "e").alias("ix"), S.count(n, "e").alias("ct"), S.countw(n).alias("cw"))


@query("f35_concatenation", "SELECT p_partkey, p_brand || p_type AS cat, trim(p_brand) || trim(p_type) AS cats, concat_ws('-', nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS catx, CAST(CASE WHEN regexp_full_match(p_brand, '[Brand#]*') THEN 0 ELSE length(regexp_extract(p_brand, '^[Brand#]*')) + 1 END AS INT) AS ver FROM part")
def _(t):
    a, b = F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", F.concat(a, b).alias("cat"), S.cats(a, b).alias("cats"), S.catx("-", a, b).alias("catx"), S.verify(a, "Brand#").alias("ver"))


@query("f39_put_input", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, upper(strftime(o_orderdate, '%d%b%Y')) AS d9, format('{:,.2f}', o_totalprice) AS comma, '$' || format('{:,.2f}', o_totalprice) AS dollar, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS z, TRY_CAST(o_orderpriority AS DOUBLE) AS num, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS back FROM orders")
def _(t):
    d, p = F.col("o_orderdate"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", S.put(d, "yymmdd10.").alias("iso"), S.put(d, "date9.").alias("d9"), S.put(p, "comma12.2").alias("comma"), S.put(p, "dollar12.2").alias("dollar"), S.put(F.col("o_orderkey"), "z8.").alias("z"), S.input_(F.col("o_orderpriority"), "best12.").alias("num"), S.input_(S.put(d, "yymmdd10."), "yymmdd10.").alias("back"))


@query("f42_dates", "SELECT event_id, make_date(CAST(year(ts) AS BIGINT), CAST(month(ts) AS BIGINT), 1) AS m1, CAST(ts AS DATE) AS dp, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS tp, CAST(date_diff('month', DATE '2020-01-15', CAST(ts AS DATE)) AS INT) AS ckm, CAST(date_diff('day', DATE '2020-01-15', CAST(ts AS DATE)) AS INT) AS ckd, CAST(date_trunc('month', CAST(ts AS DATE) + INTERVAL 2 MONTH) AS DATE) AS nxb, CAST(CAST(ts AS DATE) + INTERVAL 2 MONTH AS DATE) AS nxs, round(date_diff('day', DATE '2020-01-15', CAST(ts AS DATE)) / 365.25, 6) AS yd FROM events")
def _(t):
    ts, d = F.col("ts"), F.to_date("ts")
    base = F.lit("2020-01-15").cast("date")
    return t.events.select("event_id", S.mdy(F.month(ts), F.lit(1), F.year(ts)).alias("m1"), d.alias("dp"), S.timepart(ts).alias("tp"), S.intck("month", base, d).alias("ckm"), S.intck("day", base, d).alias("ckd"), S.intnx("month", d, 2).alias("nxb"), S.intnx("month", d, 2, "same").alias("nxs"), F.round(S.yrdif(base, d), 6).alias("yd"))


@query("f53_conditionals", "SELECT doc_id, coalesce(lang, 'none') AS lang, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS long, CASE WHEN n_chars > 1000 THEN 'L' ELSE 'S' END AS code, CAST(source IS NULL AS INT) AS miss, CAST(lang IN ('en', 'de') AS INT) AS ger, CAST(source LIKE 'src1%' AS INT) AS lk, CAST(n_chars BETWEEN 100 AND 500 AS INT) AS mid FROM documents")
def _(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), S.ifn(n > 1000, F.lit(1), F.lit(0)).alias("long"), S.ifn(n > 1000, F.lit("L"), F.lit("S")).alias("code"), S.missing(F.col("source")).alias("miss"), F.col("lang").isin("en", "de").cast("int").alias("ger"), F.col("source").like("src1%").cast("int").alias("lk"), n.between(100, 500).cast("int").alias("mid"))


# --- the transaction pipeline over orders --------------------------------------
_etl = """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'AMERICA' THEN 'NA' ELSE 'AS' END AS region, upper(trim(o_orderpriority)) AS product, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
y AS (SELECT *, amount * CASE region WHEN 'NA' THEN 0.1 WHEN 'EU' THEN 0.2 ELSE 0.05 END AS tax FROM x), z AS (SELECT *, amount + tax AS total_amount, CAST(amount + tax > 200000 AS INT) AS high_value_flag FROM y)
"""


@query("etl_transform", _etl + "SELECT o_orderkey, region, product, round(tax, 4) AS tax, round(total_amount, 4) AS total_amount, high_value_flag FROM z")
def _(t):
    from ..operators import etl

    return etl.transform(etl.order_transactions(t.orders, t.customer, t.nation, t.region), 200000).select("o_orderkey", "region", "product", F.round("tax", 4).alias("tax"), F.round("total_amount", 4).alias("total_amount"), "high_value_flag")


@query("etl_daily_summary", _etl + "SELECT date, region, product, round(sum(amount), 4) AS total_sales, round(sum(tax), 4) AS total_tax, round(sum(total_amount), 4) AS grand_total FROM z GROUP BY 1, 2, 3 HAVING sum(total_amount) > 0")
def _(t):
    from ..operators import etl

    d = etl.daily_summary(etl.transform(etl.order_transactions(t.orders, t.customer, t.nation, t.region), 200000))
    return d.select("date", "region", "product", *[F.round(c, 4).alias(c) for c in ("total_sales", "total_tax", "grand_total")])


@query("st_windowed_summary", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.replay import windowed_summary

    out = windowed_summary(t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", ["event_type"], {"value": "total"})
    return out.withColumn("total", F.round("total", 4))


# --- further inventory rows ------------------------------------------------------
@query("s06_temp_views", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def _(t):
    lib = T.Library(t.spark)
    lib.put("sup", t.supplier)
    view = lib.register_views()["work.sup"]
    return t.spark.table(view).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("p01_set", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return O.stack(t.region)


@query("p14_two_outputs", "SELECT 'a' AS ds, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    from .program import compile_program

    p = compile_program(t.spark, "data a b; set o; if o_orderstatus = 'F' then output a; else output b; run;", {"o": t.orders})
    return O.stack(*[p.library.get(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("ds"), "n") for n in "ab"])


@query("j05_comma_join", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
def _(t):
    return t.spark.sql("SELECT s_name, n_name FROM {s} AS s, {n} AS n WHERE s_nationkey = n_nationkey", s=t.supplier, n=t.nation)


@query("a10_basic", "SELECT l_linestatus, min(l_tax) AS lo, max(l_tax) AS hi, round(avg(l_tax), 6) AS mean, round(sum(l_tax), 4) AS total FROM lineitem GROUP BY 1")
def _(t):
    x = "l_tax"
    return t.lineitem.groupBy("l_linestatus").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.round(F.sum(x), 4).alias("total"))


@query("a15_skew_kurtosis", "SELECT event_type, round(skewness(value), 6) AS sample_skew, round(kurtosis(value), 6) AS sample_kurt, round(kurtosis_pop(value), 6) AS kurt FROM events GROUP BY 1")
def _(t):
    from ..functions.moments import kurtosis, skewness

    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.round(skewness(v, "sample"), 6).alias("sample_skew"), F.round(kurtosis(v, "sample"), 6).alias("sample_kurt"), F.round(kurtosis(v), 6).alias("kurt"))


@query("a17_geometric_mean", "SELECT p_brand, round(exp(avg(ln(1 + p_retailprice / 10000))) - 1, 6) AS g FROM part GROUP BY 1")
def _(t):
    from ..operators.performance import geometric_mean

    return t.part.groupBy("p_brand").agg(F.round(geometric_mean(F.col("p_retailprice") / 10000), 6).alias("g"))


@query("a19_collect", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("a21_frequency", "SELECT l_returnflag, round(avg(CASE WHEN l_discount < 0.04 THEN 1.0 ELSE 0.0 END), 6) AS freq FROM lineitem GROUP BY 1")
def _(t):
    from ..operators.performance import downside_frequency

    return t.lineitem.groupBy("l_returnflag").agg(F.round(downside_frequency(F.col("l_discount"), 0.04), 6).alias("freq"))


@query("o05_union_by_name", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    return O.stack(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("w06_running_product", "SELECT o_custkey, o_orderkey, round(exp(sum(ln(1 + o_totalprice / 1e7)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), 6) AS growth FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.orders.select("o_custkey", "o_orderkey", F.round(F.exp(F.sum(F.log(1 + F.col("o_totalprice") / 1e7)).over(w)), 6).alias("growth"))


@query("u01_fuzzy_equal", "SELECT count(*) FILTER (WHERE abs(o_totalprice - round(o_totalprice, 1)) > 0.02) AS differs FROM orders")
def _(t):
    return t.orders.agg(F.sum((F.abs(F.col("o_totalprice") - F.round("o_totalprice", 1)) > 0.02).cast("long")).alias("differs"))


@query("proc_reg_two_regressors", "SELECT l_returnflag, round(p, 4) AS quantity, round(q, 4) AS discount FROM (SELECT l_returnflag, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS p, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS q FROM (SELECT l_returnflag, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem GROUP BY 1))")
def _(t):
    x, z, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    # centred covariances: power sums would lose digits on unscaled prices
    m = t.lineitem.groupBy("l_returnflag").agg(F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"))
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    return m.select("l_returnflag", F.round((F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / det, 4).alias("quantity"), F.round((F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / det, 4).alias("discount"))


@query("proc_tabulate", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"F\", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS \"O\", round(sum(o_totalprice), 2) AS all_ FROM orders GROUP BY ROLLUP (o_orderpriority)")
def _(t):
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2).alias(s)
    return t.orders.rollup("o_orderpriority").agg(part("F"), part("O"), F.round(F.sum("o_totalprice"), 2).alias("all_"))


@query("proc_format", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Part' END AS status FROM orders")
def _(t):
    labels = F.create_map(*[F.lit(x) for kv in {"F": "Finished", "O": "Open"}.items() for x in kv])
    return t.orders.select("o_orderkey", F.coalesce(labels[F.col("o_orderstatus")], F.lit("Part")).alias("status"))
