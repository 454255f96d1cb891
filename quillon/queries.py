"""The engine's operators as queries over the Parquet tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import relational as R
from quillon.sources import parquet

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str, *tables: str):
    """Registers a function of its tables under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(parquet.read(spark, sf_dir, t) for t in tables))

        _QUERIES[f.__name__], _SQL[f.__name__] = run, sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per customer segment and year: two joins, a filter, a grouped aggregate and a sort."""
    return _QUERIES["join_three_way_grouped"](spark, sf_dir)


# --- scans and projections --------------------------------------------------------


@_query("SELECT r_regionkey, r_name FROM region", "region")
def scan_region(region):
    return R.scan(region, "r_regionkey", "r_name")


@_query("SELECT o_totalprice, o_orderdate, o_orderkey FROM orders", "orders")
def project_reorder(orders):
    return R.scan(orders, "o_totalprice", "o_orderdate", "o_orderkey")


@_query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(l_quantity AS INTEGER) AS pieces FROM lineitem", "lineitem")
def project_computed(lineitem):
    return R.project(lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber", net="round(l_extendedprice * (1 - l_discount), 4)", pieces="CAST(l_quantity AS INT)")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, trim(o_orderpriority) AS priority FROM orders", "orders")
def project_time_text(orders):
    return R.project(orders, o_orderkey="o_orderkey", shown=S.time_text(F.col("o_orderdate")), priority=S.trimmed(F.col("o_orderpriority")))


# --- filters ------------------------------------------------------------------------

_ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
_PARTS = "p_partkey p_name p_brand p_size p_retailprice".split()
_FILTERS = {
    "filter_num_gt": ("orders", _ORDERS, "o_totalprice > 250000"),
    "filter_num_lt": ("orders", _ORDERS, "o_totalprice < 20000"),
    "filter_num_eq": ("part", _PARTS, "p_size = 15"),
    "filter_num_ne": ("part", _PARTS, "p_size <> 15"),
    "filter_num_ge": ("part", _PARTS, "p_size >= 40"),
    "filter_num_le": ("part", _PARTS, "p_size <= 5"),
    "filter_text_eq": ("orders", _ORDERS, "o_orderstatus = 'F'"),
    "filter_text_ne": ("orders", _ORDERS, "o_orderstatus <> 'F'"),
    "filter_text_lt": ("orders", _ORDERS, "o_orderpriority < '3'"),
    "filter_ts_gt": ("orders", _ORDERS, "o_orderdate > TIMESTAMP '1996-06-30 00:00:00'"),
    "filter_ts_between": ("orders", _ORDERS, "o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-12-31 23:59:59'"),
    "filter_and": ("orders", _ORDERS, "o_totalprice > 100000 AND o_orderstatus = 'O' AND o_orderpriority >= '2'"),
    "filter_or_dnf": ("orders", _ORDERS, "(o_totalprice > 200000 AND o_orderstatus = 'O') OR (o_totalprice < 50000 AND o_orderstatus = 'F')"),
    "filter_nested_bool": ("orders", _ORDERS, "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND NOT (o_totalprice < 100000 OR o_orderpriority > '4')"),
    "filter_like_in_null": ("orders", _ORDERS, "o_orderpriority LIKE '1%' AND o_orderstatus IN ('O', 'F') AND o_orderdate IS NOT NULL"),
    "filter_arithmetic": ("part", _PARTS, "p_retailprice / 2 + 10 * p_size > 900"),
}


def _filter(name: str, table: str, columns: list[str], condition: str) -> None:
    spark_condition = condition.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")

    def run(rows):
        return R.scan(R.where(rows, spark_condition), *columns)

    run.__name__ = name
    _query(f"SELECT {', '.join(columns)} FROM {table} WHERE {condition}", table)(run)


for _name, _given in _FILTERS.items():
    _filter(_name, *_given)

# --- joins ----------------------------------------------------------------------------


@_query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def join_equi(orders, customer):
    return R.scan(R.join(orders, customer, [("o_custkey", "c_custkey")]), "o_orderkey", "c_name", "o_totalprice")


@_query("SELECT l_orderkey, l_linenumber, ps.l_linenumber2 AS next_line FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber - 1 AS n, l_linenumber AS l_linenumber2 FROM lineitem) ps ON l_orderkey = ps.k AND l_linenumber = ps.n", "lineitem")
def join_equi_multi_cond(lineitem):
    after = R.project(lineitem, k="l_orderkey", n="l_linenumber - 1", next_line="l_linenumber")
    return R.scan(R.join(lineitem, after, [("l_orderkey", "k"), ("l_linenumber", "n")]), "l_orderkey", "l_linenumber", "next_line")


@_query("SELECT round(avg(c_acctbal), 4) AS avg_balance FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 200000", "customer", "orders")
def join_comma_where(customer, orders):
    both = R.join(customer, R.where(orders, "o_totalprice > 200000"), [("c_custkey", "o_custkey")])
    return both.agg(F.round(F.avg("c_acctbal"), 4).alias("avg_balance"))


@_query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_acctbal > n_nationkey * 400", "supplier", "nation")
def join_theta_gt(supplier, nation):
    return R.scan(R.join(supplier, nation, condition="s_acctbal > n_nationkey * 400", small=True), "s_suppkey", "n_name")


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey <> r_regionkey", "nation", "region")
def join_theta_ne(nation, region):
    return R.scan(R.join(nation, region, condition="n_regionkey <> r_regionkey"), "n_name", "r_name")


@_query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey < r_regionkey", "nation", "region")
def join_or_predicate(nation, region):
    return R.scan(R.join(nation, region, condition="n_regionkey = r_regionkey OR n_nationkey < r_regionkey"), "n_name", "r_name")


@_query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2 AND c_acctbal > 1000", "customer", "nation")
def join_literal_cond(customer, nation):
    return R.scan(R.join(customer, nation, [("c_nationkey", "n_nationkey")], "n_regionkey = 2 AND c_acctbal > 1000", small=True), "c_custkey", "n_name")


@_query("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region", "nation", "region")
def cross_product(nation, region):
    return R.scan(R.join(nation, region), "n_nationkey", "r_regionkey")


@_query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "orders", "customer", "nation")
def join_three_way(orders, customer, nation):
    return R.scan(R.join(R.join(orders, customer, [("o_custkey", "c_custkey")]), nation, [("c_nationkey", "n_nationkey")], small=True), "o_orderkey", "c_name", "n_name")


@_query(
    """SELECT c_mktsegment, year(o_orderdate) AS year, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sales
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 10 GROUP BY ALL ORDER BY ALL""",
    "lineitem",
    "orders",
    "customer",
)
def join_three_way_grouped(lineitem, orders, customer):
    sold = R.join(R.join(R.where(lineitem, "l_quantity > 10"), orders, [("l_orderkey", "o_orderkey")]), customer, [("o_custkey", "c_custkey")])
    sold = sold.groupBy("c_mktsegment", F.year("o_orderdate").cast("long").alias("year"))
    return R.order(sold.agg(F.count("*").alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sales")), "c_mktsegment", "year")


@_query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_linestatus = o_orderstatus AND l_orderkey = o_orderkey", "lineitem", "orders")
def join_text_key(lineitem, orders):
    return R.scan(R.join(lineitem, orders, [("l_linestatus", "o_orderstatus"), ("l_orderkey", "o_orderkey")]), "l_orderkey", "l_linenumber", "o_orderstatus")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate", "lineitem", "orders")
def join_ts_cmp(lineitem, orders):
    return R.scan(R.join(lineitem, orders, [("l_orderkey", "o_orderkey")], "l_shipdate > o_orderdate"), "l_orderkey", "l_linenumber")


@_query("SELECT a.n_name AS n_name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
def self_join(nation):
    other = R.project(nation, k="n_nationkey", r="n_regionkey", neighbour="n_name")
    return R.scan(R.join(nation, other, [("n_regionkey", "r")], "n_nationkey < k"), "n_name", "neighbour")


for _how, _sql_how in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    def _outer(orders, customer, how=_how):
        rich = R.where(orders, "o_totalprice > 300000")
        return R.scan(R.join(R.where(customer, "c_acctbal > 0"), rich, [("c_custkey", "o_custkey")], how=how), "c_custkey", "o_orderkey", "o_totalprice")

    _outer.__name__ = f"{_how}_join"
    _query(f"SELECT c_custkey, o_orderkey, o_totalprice FROM (FROM customer WHERE c_acctbal > 0) {_sql_how} JOIN (FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey", "orders", "customer")(_outer)


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders")
def semi_join(customer, orders):
    return R.scan(R.join(customer, R.where(orders, "o_totalprice > 300000"), [("c_custkey", "o_custkey")], how="left_semi"), "c_custkey", "c_name")


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders")
def anti_join(customer, orders):
    return R.scan(R.join(customer, R.where(orders, "o_totalprice > 300000"), [("c_custkey", "o_custkey")], how="left_anti"), "c_custkey", "c_name")


_PAIRED = "SELECT o_orderkey, l_linenumber, c_name, p_brand FROM (orders JOIN customer ON o_custkey = c_custkey) JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey WHERE p_size > 25 AND c_acctbal > 0"


@_query(_PAIRED, "orders", "customer", "lineitem", "part")
def join_bushy(orders, customer, lineitem, part):
    left = R.join(orders, R.where(customer, "c_acctbal > 0"), [("o_custkey", "c_custkey")])
    right = R.join(lineitem, R.where(part, "p_size > 25"), [("l_partkey", "p_partkey")])
    return R.scan(R.join(left, right, [("o_orderkey", "l_orderkey")]), "o_orderkey", "l_linenumber", "c_name", "p_brand")


for _hint in ("merge", "shuffle_hash"):

    def _hinted(orders, customer, hint=_hint):
        return R.scan(R.join(orders, customer, [("o_custkey", "c_custkey")], hint=hint), "o_orderkey", "c_name")

    _hinted.__name__ = f"join_hint_{_hint}"
    _query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")(_hinted)


@_query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 50 AND s_acctbal + 50", "customer", "supplier")
def join_interval(customer, supplier):
    spans = supplier.select("s_suppkey", (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return R.interval_join(customer.select("c_custkey", "c_acctbal"), spans, "c_acctbal", "low", "high", 100).select("c_custkey", "s_suppkey")


_ASOF = """WITH seen AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, s.seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN seen s ON e.user_id = s.user_id AND e.ts >= s.ts"""


@_query(_ASOF, "events")
def join_asof(events):
    seen = R.grouped(R.where(events, "event_type = 'view'"), ["user_id", "ts"], seen=("max", "event_id"))
    bought = R.where(events, "event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(bought, seen, ["user_id"], "ts", ["seen"]).select("event_id", "seen")


# --- aggregates -------------------------------------------------------------------------

for _name, _function, _column, _sql in (
    ("agg_max_num", "max", "o_totalprice", "max(o_totalprice)"),
    ("agg_min_num", "min", "o_totalprice", "min(o_totalprice)"),
    ("agg_max_ts", "max", "o_orderdate", "max(o_orderdate)"),
    ("agg_min_ts", "min", "o_orderdate", "min(o_orderdate)"),
    ("agg_min_text", "min", "o_orderpriority", "min(o_orderpriority)"),
    ("agg_count_num", "count", "o_totalprice", "count(o_totalprice)"),
    ("agg_count_text", "count", "o_orderstatus", "count(o_orderstatus)"),
    ("count_star", "count", "*", "count(*)"),
    ("count_distinct", "count_distinct", "o_custkey", "count(DISTINCT o_custkey)"),
):

    def _total(orders, function=_function, column=_column):
        return R.total(orders, value=(function, column))

    _total.__name__ = _name
    _query(f"SELECT {_sql} AS value FROM orders", "orders")(_total)


@_query("SELECT round(sum(o_totalprice), 2) AS value FROM orders", "orders")
def agg_sum(orders):
    return orders.agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@_query("SELECT round(avg(o_totalprice), 4) AS value FROM orders", "orders")
def agg_avg(orders):
    return orders.agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@_query("SELECT max(l_quantity) AS most, min(l_shipdate) AS first, count(*) AS n, round(avg(l_discount), 6) AS discount, round(sum(l_tax), 2) AS tax FROM lineitem", "lineitem")
def agg_multi(lineitem):
    return lineitem.agg(F.max("l_quantity").alias("most"), F.min("l_shipdate").alias("first"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.sum("l_tax"), 2).alias("tax"))


@_query("SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'", "lineitem", "orders")
def agg_over_join(lineitem, orders):
    return R.join(lineitem, R.where(orders, "o_orderstatus = 'O'"), [("l_orderkey", "o_orderkey")]).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


@_query("SELECT count(*) AS n, max(o_totalprice) AS most, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice < 0", "orders")
def agg_empty_input(orders):
    return R.total(R.where(orders, "o_totalprice < 0"), n=("count", "*"), most=("max", "o_totalprice"), total=("sum", "o_totalprice"), mean=("avg", "o_totalprice"))


@_query("SELECT round(stddev_samp(o_totalprice), 2) AS spread, median(o_custkey) AS middle FROM orders", "orders")
def agg_spread(orders):
    (middle,) = R.exact_quantiles(orders, "o_custkey", [0.5])
    return orders.agg(F.round(F.stddev_samp("o_totalprice"), 2).alias("spread")).withColumn("middle", F.lit(middle).cast("double"))


@_query("SELECT abs(count(DISTINCT o_custkey) - n) <= 0.1 * n AS near FROM orders, (SELECT count(DISTINCT o_custkey) AS n FROM orders) GROUP BY n", "orders")
def approx_distinct(orders):
    # A sketch of different values is that of all; beside count_distinct in one aggregate Spark would keep a sketch a value.
    counts = R.scan(orders, "o_custkey").distinct().agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count("o_custkey").alias("n"), F.count("*").alias("rows"))
    return counts.filter("rows > 0").select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL", "lineitem")
def group_by(lineitem):
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", "orders")
def having(orders):
    return R.grouped(orders, ["o_custkey"], "n > 15", n=("count", "*"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
def rollup(lineitem):
    return R.grouped(lineitem, ["l_returnflag", "l_linestatus"], kind="rollup", n=("count", "*"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
def cube(lineitem):
    return R.grouped(lineitem, ["l_returnflag", "l_linestatus"], kind="cube", n=("count", "*"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))", "lineitem")
def grouping_sets(lineitem):
    return lineitem.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# --- sorts and limits ---------------------------------------------------------------------


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey", "part")
def sort_num_asc(part):
    return R.order(R.scan(part, "p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey", "part")
def sort_num_desc(part):
    return R.order(R.scan(part, "p_partkey", "p_retailprice"), "p_retailprice desc", "p_partkey")


@_query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey", "part")
def sort_text(part):
    return R.order(R.scan(part, "p_name", "p_partkey"), "p_name", "p_partkey")


@_query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey", "orders")
def sort_ts(orders):
    return R.order(R.scan(orders, "o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_totalprice", "orders")
def sort_over_filter(orders):
    return R.order(R.scan(R.where(orders, "o_orderdate > TIMESTAMP_NTZ '1997-01-01 00:00:00'"), "o_orderkey", "o_totalprice"), "o_totalprice")


@_query("SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment, c_custkey", "customer")
def multi_key_sort(customer):
    return R.order(R.scan(customer, "c_nationkey", "c_mktsegment", "c_custkey"), "c_nationkey desc", "c_mktsegment", "c_custkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", "orders")
def limit_topk(orders):
    return R.top(R.scan(orders, "o_orderkey", "o_totalprice"), 25, "o_totalprice desc", "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 20", "orders")
def limit_offset(orders):
    return R.top(R.scan(orders, "o_orderkey", "o_totalprice"), 10, "o_totalprice desc", "o_orderkey", offset=20)


# --- set operations -------------------------------------------------------------------------


@_query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "customer")
def distinct(customer):
    return R.scan(customer, "c_mktsegment", "c_nationkey").distinct()


@_query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_all(customer, supplier):
    return R.project(customer, k="c_nationkey").union(R.project(supplier, k="s_nationkey"))


@_query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_distinct(customer, supplier):
    return R.project(customer, k="c_nationkey").union(R.project(supplier, k="s_nationkey")).distinct()


@_query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", "customer", "orders")
def intersect(customer, orders):
    return R.project(customer, k="c_custkey").intersect(R.project(R.where(orders, "o_totalprice > 300000"), k="o_custkey"))


@_query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", "customer", "orders")
def except_(customer, orders):
    return R.project(customer, k="c_custkey").subtract(R.project(R.where(orders, "o_totalprice > 300000"), k="o_custkey"))


_QUERIES["except"], _SQL["except"] = _QUERIES.pop("except_"), _SQL.pop("except_")

# --- windows ----------------------------------------------------------------------------------


@_query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders", "orders")
def window_rank(orders):
    return R.ranked(R.scan(orders, "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice desc", "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@_query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders", "orders")
def window_running_sum(orders):
    out = R.running(R.scan(orders, "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], "o_totalprice", "o_orderdate", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"))


_BY_CUSTOMER = ("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")


@_query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders", "orders")
def window_row_number(orders):
    return R.ranked(R.scan(orders, *_BY_CUSTOMER), ["o_custkey"], "o_orderdate", "o_orderkey", name="place", function="row_number").select("o_orderkey", F.col("place").cast("long").alias("place"))


@_query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS place, ntile(2) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS half FROM lineitem", "lineitem")
def window_dense_rank_ntile(lineitem):
    rows = R.ranked(R.scan(lineitem, "l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity", name="place", function="dense_rank")
    rows = R.ranked(rows, ["l_orderkey"], "l_quantity", "l_linenumber", name="half", function="ntile", of=2)
    return rows.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), F.col("half").cast("long").alias("half"))


@_query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders")
def window_lag_lead(orders):
    rows = R.shifted(R.scan(orders, *_BY_CUSTOMER), ["o_custkey"], "o_orderkey", "o_orderdate", "o_orderkey", name="before")
    return R.shifted(rows, ["o_custkey"], "o_orderkey", "o_orderdate", "o_orderkey", name="later", places=-2).select("o_orderkey", "before", "later")


@_query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 90 PRECEDING AND 30 FOLLOWING), 2) AS around FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)", "orders")
def window_range_frame(orders):
    rows = R.scan(orders, *_BY_CUSTOMER).withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    return R.within(rows, ["o_custkey"], "o_totalprice", "day", 90, 30, "around").select("o_orderkey", F.round("around", 2).alias("around"))


# --- SQL text -----------------------------------------------------------------------------------


def _text(name: str, sql: str, *tables: str, duck: str | None = None) -> None:
    """A query given as SQL; it runs in an engine of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillon.plans.engine import Engine

        return Engine(spark, sf_dir, *tables).sql(sql)

    _QUERIES[name], _SQL[name] = run, duck or sql


_text(
    "scalar_subquery_correlated",
    "SELECT c_custkey, c_name, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50000) AS spent FROM customer WHERE c_acctbal > 9000 ORDER BY spent DESC",
    "customer",
    "orders",
)
_text("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer", "orders")
_text("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", "orders")
_text("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", "orders")
_text(
    "cte",
    "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_nationkey, count(*) AS n, round(max(total), 2) AS most FROM spent JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "customer",
    "orders",
)
_text("quoted_names", 'SELECT "n_name" AS "Nation; name" FROM nation WHERE n_name <> \'a;b\'; SELECT 1', "nation", duck='SELECT "n_name" AS "Nation; name" FROM nation WHERE n_name <> \'a;b\'')

# --- nulls, and set operations that count -----------------------------------------------------------

_NULLS = "(SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS r, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS name FROM nation) AS t"
_text("sort_nulls_first", f"SELECT k, r FROM {_NULLS} ORDER BY r NULLS FIRST, k LIMIT 13", "nation")
_text("sort_nulls_last", f"SELECT k, name FROM {_NULLS} ORDER BY name DESC, k LIMIT 20", "nation", duck=f"SELECT k, name FROM {_NULLS} ORDER BY name DESC NULLS LAST, k LIMIT 20")
_text("join_null_keys", f"SELECT t.k, r_name FROM {_NULLS} LEFT JOIN region ON r = r_regionkey", "nation", "region")
_text("group_null_keys", f"SELECT r, count(*) AS n, count(name) AS names, min(name) AS first FROM {_NULLS} GROUP BY r", "nation")
_text("not_in_with_null", f"SELECT r_name FROM region WHERE r_regionkey NOT IN (SELECT r FROM {_NULLS})", "nation", "region")
_text("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_text("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")

# --- typed CSV ----------------------------------------------------------------------------------------

#: Tables as typed CSV, with blanks: what is written, and primary keys.
_CSV = {
    "customer": ("SELECT c_custkey AS customer_id, c_name AS name, CASE WHEN c_custkey % 10 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE '' END AS segment FROM customer", ("customer_id",)),
    "orders": ("SELECT o_orderkey AS orders_id, o_custkey AS customer_id, o_totalprice AS total, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS day FROM orders", ("orders_id",)),
    "region": ("SELECT r_regionkey AS region_id, r_name FROM region", ("region_id",)),
    "nation": ("SELECT n_nationkey AS nation_id, n_name, n_regionkey AS region_id FROM nation", ("nation_id",)),
    # a key that comes twice, one that is blank, and references to nothing
    "broken": ("SELECT CASE WHEN n_nationkey < 3 THEN 7 WHEN n_nationkey > 3 THEN n_nationkey END AS broken_id, n_regionkey + 2 AS region_id FROM nation", ("broken_id",)),
}
#: The same in DuckDB, as the reader gives it: numbers are 32-bit floats, blanks null.
_AS_READ = {
    "customer": "SELECT c_custkey AS customer_id, c_name AS name, CASE WHEN c_custkey % 10 > 0 THEN CAST(c_acctbal AS FLOAT) END AS balance, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment FROM customer",
    "orders": "SELECT o_orderkey AS orders_id, o_custkey AS customer_id, CAST(o_totalprice AS FLOAT) AS total, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS day FROM orders",
    "region": _CSV["region"][0],
    "nation": _CSV["nation"][0],
}


def _exported(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """The tables as typed CSV in a new folder."""
    import uuid

    from quillon.sources.scratch import scratch_dir
    from quillon.sources.typed_csv import write_table

    folder, session = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}", spark.newSession()
    parquet.register(session, sf_dir, "customer", "orders", "region", "nation")
    for t in tables:
        sql, primary = _CSV[t]
        write_table(session.sql(sql), folder, t, primary)
    return folder


def _csv(name: str, sql: str, *tables: str, duck: str | None = None) -> None:
    """A query over typed CSV, which is written first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillon.plans.engine import Engine

        return Engine(spark, _exported(spark, sf_dir, tables)).sql(sql)

    _QUERIES[name], _SQL[name] = run, f"WITH {', '.join(f'{t}_csv AS ({_AS_READ[t]})' for t in tables)} {duck or sql}"


_csv(
    "csv_scan",
    "SELECT CAST(orders_id AS BIGINT) AS id, CAST(customer_id AS BIGINT) AS customer, CAST(total AS DOUBLE) AS total, day FROM orders",
    "orders",
    duck="SELECT orders_id AS id, customer_id AS customer, CAST(total AS DOUBLE) AS total, day FROM orders_csv",
)
_csv("csv_blanks", "SELECT count(*) AS n, count(balance) AS balances, count(segment) AS segments, min(segment) AS first FROM customer", "customer", duck="SELECT count(*) AS n, count(balance) AS balances, count(segment) AS segments, min(segment) AS first FROM customer_csv")
_csv(
    "csv_float_literals",
    "SELECT CAST(orders_id AS BIGINT) AS id FROM orders WHERE total <= 20000.55 OR total > 250000.25 AND day IS NULL",
    "orders",
    duck="SELECT orders_id AS id FROM orders_csv WHERE total <= CAST(20000.55 AS FLOAT) OR total > CAST(250000.25 AS FLOAT) AND day IS NULL",
)
_csv(
    "csv_join_avg",
    "SELECT round(avg(c.balance), 4) AS mean FROM customer c, orders o WHERE c.customer_id = o.customer_id AND o.total > 200000",
    "customer",
    "orders",
    duck="SELECT round(avg(CAST(c.balance AS DOUBLE)), 4) AS mean FROM customer_csv c, orders_csv o WHERE c.customer_id = o.customer_id AND o.total > 200000",
)
_csv(
    "csv_time_filter_sort",
    "SELECT CAST(orders_id AS BIGINT) AS id, CAST(total AS DOUBLE) AS total FROM orders WHERE day > '1996-06-30 00:00:00' ORDER BY total, id LIMIT 40",
    "orders",
    duck="SELECT orders_id AS id, CAST(total AS DOUBLE) AS total FROM orders_csv WHERE day > TIMESTAMP '1996-06-30 00:00:00' ORDER BY total, id LIMIT 40",
)
_csv(
    "csv_correlated_sum",
    "SELECT c.name, (SELECT round(sum(o.total), 2) FROM orders o WHERE o.customer_id = c.customer_id) AS spent FROM customer c ORDER BY spent DESC",
    "customer",
    "orders",
    duck="SELECT c.name, (SELECT round(sum(CAST(o.total AS DOUBLE)), 2) FROM orders_csv o WHERE o.customer_id = c.customer_id) AS spent FROM customer_csv c",
)


def csv_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violated keys of typed CSV tables, and how many rows violate them."""
    from quillon.plans.engine import Engine

    engine = Engine(spark, _exported(spark, sf_dir, ("region", "nation", "broken")))
    found = engine.folder.check_keys(engine.spark)
    return spark.createDataFrame(sorted(found.items()), "what string, n long")


_QUERIES["csv_key_check"] = csv_key_check
_SQL["csv_key_check"] = f"""WITH broken AS ({_CSV["broken"][0]})
SELECT 'broken primary key' AS what, CAST(sum(CASE WHEN broken_id IS NULL THEN c ELSE c - 1 END) AS BIGINT) AS n FROM (SELECT broken_id, count(*) AS c FROM broken GROUP BY broken_id)
UNION ALL SELECT 'broken.region_id -> region', count(*) FROM broken WHERE region_id NOT IN (SELECT r_regionkey FROM region)"""


def csv_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file's lines of a join on a key that bears its parent's name, so that two columns are named alike."""
    from quillon.plans.engine import Engine
    from quillon.sources import results

    engine = Engine(spark, _exported(spark, sf_dir, ("region", "nation")))
    return results.lines(engine.sql("SELECT * FROM nation n JOIN region r ON n.region_id = r.region_id"))


_QUERIES["csv_result_lines"] = csv_result_lines
_SQL["csv_result_lines"] = "SELECT concat(n_nationkey, ', ', n_name, ', ', n_regionkey, ', ', r_regionkey, ', ', r_name) AS line FROM nation JOIN region ON n_regionkey = r_regionkey"
