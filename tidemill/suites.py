"""Registered queries: one for each operator, and the star-schema and TPC-H-like suites, with DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, like_column, prefix, suffix
from .operators import relational as R
from .operators import reverse as V
from .plans import algebra as A
from .plans.algebra import Agg, Rel, alias, col, fn, lower
from .plans.workload import Session, star_workload
from .sources import TABLES, import_tbl, load, register_views, shared_root, write

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}

#: Unique keys of the base tables; lineitem has none.
KEYS = {"region": (("r_regionkey",),), "nation": (("n_nationkey",),), "customer": (("c_custkey",),), "supplier": (("s_suppkey",),), "part": (("p_partkey",),), "orders": (("o_orderkey",),), "lineitem": (), "events": (("event_id",),)}


class Tables:
    """Base tables by attribute, and algebra over them by call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def __call__(self, q: A.Query) -> DataFrame:
        return lower(q, lambda x: getattr(self, x.name) if isinstance(x, Rel) else None)


def query(name: str, sql: str):
    """Register a function of the tables and its oracle."""

    def put(f):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _ORACLE[name] = sql
        return f

    return put


def algebra(name: str, q: A.Query, sql: str) -> None:
    query(name, sql)(lambda t: t(q))


def sql_query(name: str, text: str) -> None:
    """A query whose text both engines run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", text)))
        return spark.sql(text)

    _QUERIES[name], _ORACLE[name] = run, text


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["ssb_q4_1"](spark, sf_dir)


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def total(c: Column) -> Column:
    return F.sum(c).cast("double")


c = col
P = Rel("part")
O = Rel("orders")  # noqa: E741
L = Rel("lineitem")
N = Rel("nation")
S = Rel("supplier")
C = Rel("customer")

# scans, filters
algebra("scan_region", Rel("region"), "SELECT * FROM region")
algebra("filter_and_or_not", O.where((c("o_orderstatus").eq("F") & (c("o_totalprice") > 150000.0)) | ~(c("o_orderkey") < 14000)).keep("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 150000.0) OR NOT o_orderkey < 14000")
algebra("filter_between", L.where(c("l_quantity").between(10.0, 12.0)).keep("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
algebra("filter_in_list", O.where(c("o_orderpriority").isin("1-URGENT", "5-LOW")).keep("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
algebra("filter_not_in_list", O.where(~c("o_orderpriority").isin("1-URGENT", "5-LOW")).keep("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
algebra("filter_ne", C.where(c("c_mktsegment").ne("BUILDING")).keep("c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
algebra("filter_range", O.where((c("o_totalprice") >= 1000.0) & (c("o_totalprice") < 50000.0) & (c("o_orderkey") > 10) & (c("o_orderkey") <= 9000)).keep("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderkey > 10 AND o_orderkey <= 9000")
algebra("filter_like_prefix", P.where(c("p_name").like("co%")).keep("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'co%'")
algebra("filter_like_suffix", P.where(c("p_name").like("%widget")).keep("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget'")
algebra("filter_like_infix", P.where(c("p_name").like("%o%d%")).keep("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%o%d%'")
algebra("filter_like_exact", P.where(c("p_type").like("PROMO")).keep("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO'")
algebra("filter_not_like", P.where(~c("p_name").like("%widget")).keep("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%widget'")
query("filter_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'ld')")(lambda t: R.select(t.part, F.col("p_name").contains("ld")).select("p_partkey"))



@query("import_tbl", "SELECT * FROM orders")
def _import_tbl(t):
    """A table written as pipe-delimited text, with a bar at the end of each line, and imported again."""
    path = shared_root(t.spark, "tidemill-tbl")
    t.orders.select(F.concat(*(x for f in t.orders.columns for x in (F.col(f).cast("string"), F.lit("|")))).alias("value")).write.text(path)
    return import_tbl(t.spark, path, t.orders.schema)


@query("write_table", "SELECT * FROM customer")
def _write_table(t):
    path = shared_root(t.spark, "tidemill-written")
    write(t.customer, path)
    return t.spark.read.parquet(path)


# projections
algebra("project_arith", L.select(l_orderkey=c("l_orderkey"), a=c("l_linenumber") * 3 + 1, b=c("l_linenumber") - 2, d=c("l_quantity") / 2), "SELECT l_orderkey, l_linenumber * 3 + 1 AS a, l_linenumber - 2 AS b, l_quantity / 2 AS d FROM lineitem")
algebra("project_case_when", P.select(p_partkey=c("p_partkey"), large=fn("case", c("p_size") > 25, 1, 0)), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part")
algebra("project_substring", C.select(c_custkey=c("c_custkey"), s=fn("substring", c("c_mktsegment"), 2, 3)), "SELECT c_custkey, substring(c_mktsegment, 2, 3) AS s FROM customer")
query("project_prefix_suffix", "SELECT c_custkey, left(c_mktsegment, 2) AS p, right(c_mktsegment, 3) AS s FROM customer")(lambda t: R.project(t.customer, {"c_custkey": F.col("c_custkey"), "p": prefix(F.col("c_mktsegment"), 2), "s": suffix(F.col("c_mktsegment"), 3)}))
algebra("project_extract_year_month_day", O.select(o_orderkey=c("o_orderkey"), y=fn("year", c("o_orderdate")), m=fn("month", c("o_orderdate")), d=fn("day", c("o_orderdate"))), "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders")
algebra("project_abs_sign_neg", C.select(c_custkey=c("c_custkey"), a=fn("abs", c("c_acctbal")), s=fn("sign", c("c_acctbal")), n=-c("c_acctbal")), "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS DOUBLE) AS s, -c_acctbal AS n FROM customer")
query("project_concat", "SELECT r_regionkey, r_name || '-' || r_name AS n FROM region")(lambda t: R.project(t.region, {"r_regionkey": F.col("r_regionkey"), "n": F.concat("r_name", F.lit("-"), "r_name")}))
query("project_boolean", "SELECT p_partkey, p_size = 10 AS e, p_size <> 10 AS n, p_name LIKE 'co%' AND p_size < 20 AS b FROM part")(lambda t: R.project(t.part, {"p_partkey": F.col("p_partkey"), "e": F.col("p_size") == 10, "n": F.col("p_size") != 10, "b": like_column(F.col("p_name"), "co%") & (F.col("p_size") < 20)}))
sql_query("date_interval_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY AND l_shipdate >= DATE '1997-12-31' + INTERVAL '1' MONTH")
sql_query("select_star_comment", "SELECT * FROM nation -- all columns\nWHERE n_nationkey < 12")
query("alias_self_join", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda t: t(alias(N, "a", t.nation.columns).join(alias(N, "b", t.nation.columns), c("a_n_regionkey").eq(c("b_n_regionkey")) & (c("a_n_nationkey") < c("b_n_nationkey"))).select(a_name=c("a_n_name"), b_name=c("b_n_name")))
)

# joins
algebra("cross_product", A.Product(Rel("region"), N).keep("r_name", "n_name"), "SELECT r_name, n_name FROM region, nation")
algebra("equi_join", O.join(C, c("o_custkey").eq(c("c_custkey"))).keep("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
algebra("equi_join_multi_key", L.join(alias(L.where(c("l_quantity") > 45.0), "x", ["l_orderkey", "l_suppkey", "l_quantity"]), c("l_orderkey").eq(c("x_l_orderkey")) & c("l_suppkey").eq(c("x_l_suppkey"))).keep("l_orderkey", "l_suppkey", "l_linenumber", "x_l_quantity"), "SELECT a.l_orderkey, a.l_suppkey, a.l_linenumber, b.l_quantity AS x_l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE b.l_quantity > 45")
algebra("join_expr_key", S.join(C, (c("s_suppkey") * 10).eq(c("c_custkey") + 1)).keep("s_suppkey", "c_custkey"), "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey * 10 = c_custkey + 1")
algebra("theta_join", N.join(S, c("n_nationkey") < c("s_nationkey")).keep("n_name", "s_suppkey"), "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey < s_nationkey")
algebra("equi_plus_theta_join", O.join(L, c("o_orderkey").eq(c("l_orderkey")) & (c("l_shipdate") > c("o_orderdate")) & (c("l_quantity") > 40.0)).keep("o_orderkey", "l_linenumber", "l_quantity"), "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 40")
algebra("left_outer_join", A.LeftOuter(c("o_orderkey").eq(c("l_orderkey")), O, L).keep("o_orderkey", "l_linenumber"), "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
algebra("left_antijoin", A.LeftAnti(c("o_orderkey").eq(c("l_orderkey")), O, L).keep("o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
algebra("right_antijoin", A.RightAnti(c("l_orderkey").eq(c("o_orderkey")), L, O).keep("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
algebra("semi_exists", A.Semi(c("c_custkey").eq(c("o_custkey")), C, O.where(c("o_totalprice") > 300000.0)).keep("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql_query("in_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)")
sql_query("scalar_agg_subquery", "SELECT p_partkey, p_size FROM part WHERE p_size > (SELECT avg(p_size) FROM part)")
sql_query("correlated_agg_subquery", "SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)")
query("distinct_of", "SELECT DISTINCT p_brand, p_type FROM part")(lambda t: R.distinct_of(t.part, ["p_brand", "p_type"]))
for _hint in ("merge", "shuffle_hash", "broadcast"):
    query(f"join_strategy_{_hint}", "SELECT l_orderkey, l_linenumber, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")(
        lambda t, h=_hint: R.join(t.lineitem, t.supplier.hint(h), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_nationkey")
    )
query("join3_counts", "SELECT (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS joined, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS left_only, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS right_only")(
    lambda t: (lambda j: j.join.agg(F.count(F.lit(1)).alias("joined")).crossJoin(j.left_anti.agg(F.count(F.lit(1)).alias("left_only"))).crossJoin(j.right_anti.agg(F.count(F.lit(1)).alias("right_only"))))(V.join3(t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")))
)

# aggregation
query("group_by_expr", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")(lambda t: R.group(t.orders, [extract("year", F.col("o_orderdate"))], {"y": F.first(F.col("_k0")).cast("long"), "n": F.count(F.lit(1))}))
query("global_agg", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem")(lambda t: R.group(t.lineitem, [], {"revenue": total(money("l_extendedprice") * money("l_discount"))}))
query(
    "agg_all",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, count(l_orderkey) AS nn, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1, 2",
)(
    lambda t: R.group(
        t.lineitem,
        [F.col("l_returnflag"), F.col("l_linestatus")],
        {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus"), "s": total(money("l_extendedprice")), "a": F.round(F.avg("l_quantity"), 6), "lo": F.min("l_quantity"), "hi": F.max("l_quantity"), "n": F.count(F.lit(1)), "nn": F.count("l_orderkey"), "d": F.count_distinct("l_suppkey")},
        ["l_returnflag", "l_linestatus"],
    )
)
algebra("agg_expr_over_agg", L.group((c("l_returnflag"),), l_returnflag=c("l_returnflag"), r=Agg("max", c("l_quantity")) - Agg("min", c("l_quantity")), q=Agg("sum", c("l_linenumber")) * 2), "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS r, CAST(sum(l_linenumber) * 2 AS BIGINT) AS q FROM lineitem GROUP BY 1")
algebra("agg_first_dependent", O.join(C, c("o_custkey").eq(c("c_custkey"))).group((c("c_custkey"),), c_custkey=c("c_custkey"), c_name=Agg("first", c("c_name")), n=Agg("count")), "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
algebra("having", O.group((c("o_custkey"),), o_custkey=c("o_custkey"), n=Agg("count")).where(c("n") > 12), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")

# order, limit, sets
algebra("order_desc_limit", A.Limit(10, A.Sort(((c("o_totalprice"), True), (c("o_orderkey"), False)), O.keep("o_orderkey", "o_totalprice"))), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
algebra("order_by_expression", A.Limit(20, A.Sort(((-c("c_acctbal") * 2, False), (c("c_custkey"), False)), C.keep("c_custkey", "c_acctbal"))), "SELECT c_custkey, c_acctbal FROM customer ORDER BY -c_acctbal * 2, c_custkey LIMIT 20")
algebra("limit_drop", A.Drop(20, A.Sort(((c("c_custkey"), False),), C.keep("c_custkey", "c_name"))), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 20")
algebra("union_bag", A.Union(C.where(c("c_nationkey") < 10).keep("c_custkey", "c_nationkey"), C.where(c("c_nationkey") < 15).keep("c_custkey", "c_nationkey")), "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 15")
algebra("union_padded", A.Union(S.keep("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), S.keep("s_suppkey")), "SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, '', 0.0, 0 FROM supplier")
sql_query("nested_from_subquery", "SELECT q.n, count(*) AS k FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS q GROUP BY q.n")

# complements and their inverses
query("split_rest", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 5000)")(lambda t: V.split(t.customer, F.col("c_acctbal") > 5000)[1].select("c_custkey"))
query("rt_select", "SELECT * FROM orders")(lambda t: V.unsplit(*V.split(t.orders, F.col("o_totalprice") > 100000)))
query("rt_limit", "SELECT * FROM orders")(lambda t: V.unlimit(*V.split_limit(t.orders, [F.col("o_totalprice").desc()], ["o_orderkey"], 100)))
query("rt_project", "SELECT * FROM orders")(
    lambda t: V.unproject(*V.split_project(t.orders, {"negated": -F.col("o_totalprice")}, {"o_totalprice"}, ["o_orderkey"]), ["o_orderkey"], {"o_totalprice": -F.col("negated")}, t.orders.columns)
)


def _join3(t):
    return V.join3(t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))


query("rt_unjoin_left", "SELECT * FROM orders")(lambda t: (lambda j: V.unjoin(j.join, j.left_anti, t.orders.columns, ["o_orderkey"]))(_join3(t)))
query("rt_unjoin_right", "SELECT * FROM customer")(
    lambda t: (lambda j: V.unjoin(j.join, j.right_anti, t.customer.columns, ["c_custkey"]))(V.join3(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey")))
)


# reuse
def session(t: Tables, budget: int | None = None) -> Session:
    s = Session(t.spark, shared_root(t.spark, "tidemill-store"), budget)
    for name, keys in KEYS.items():
        s.register(name, getattr(t, name), keys)
    return s


def _three(order: str) -> A.Query:
    q = {"a": L.join(O, c("l_orderkey").eq(c("o_orderkey"))).join(C, c("o_custkey").eq(c("c_custkey"))), "b": C.join(O.join(L, c("o_orderkey").eq(c("l_orderkey"))), c("c_custkey").eq(c("o_custkey")))}[order]
    return q.where(c("l_quantity") > 40.0).group((c("c_mktsegment"),), c_mktsegment=c("c_mktsegment"), n=Agg("count"), q=Agg("sum", c("l_linenumber")))


_THREE_SQL = "SELECT c_mktsegment, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 40 GROUP BY 1"


@query("reuse_same", _THREE_SQL)
def _reuse_same(t):
    s = session(t)
    s.run([_three("a"), _three("a")])
    return s.query(_three("a"))


@query("reuse_join_permuted", _THREE_SQL)
def _reuse_permuted(t):
    s = session(t)
    s.run([_three("a")])
    return s.query(_three("b"))


@query("reuse_budget_zero", _THREE_SQL)
def _reuse_zero(t):
    s = session(t, 0)
    s.run([_three("a")])
    return s.query(_three("a"))


@query("reuse_evict_rebuild", "SELECT * FROM orders")
def _reuse_rebuild(t):
    s = session(t)
    s.run([O.join(C, c("o_custkey").eq(c("c_custkey")))], complements=True)
    s.planner.forget_table("orders")
    return s.query(O)


@query("reuse_sql", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey > 5 AND o_custkey > 3 GROUP BY 1")
def _reuse_sql(t):
    s = session(t)
    s.sql("SELECT o_orderpriority AS o, count(*) AS k FROM orders WHERE o_custkey > 3 AND o_orderkey > 5 GROUP BY 1", keep=True)
    return s.sql("SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE 5 < o_orderkey AND o_custkey > 3 GROUP BY 1")


def _with_counts(df: DataFrame, reports) -> DataFrame:
    """A result beside what the session did: results that were there, joins on kept joins, joins that ran, relations rebuilt and given up."""
    counts = {"reused": sum(r.reused for r in reports), "views": sum(r.views for r in reports), "joins": sum(r.joins for r in reports), "rebuilt": sum(r.rebuilt for r in reports), "evicted": sum(r.evicted for r in reports)}
    return df.withColumns({k: F.lit(v) for k, v in counts.items()})


@query("reuse_budget_half", "SELECT o_orderkey, o_totalprice, 3 AS reused, 0 AS views, 0 AS joins, 0 AS rebuilt, 1 AS evicted FROM orders WHERE o_totalprice < 100000 OR o_totalprice >= 400000")
def _reuse_half(t):
    """Three selections of which two fit: the third takes the place of the one that was not asked for again."""
    parts = [O.where(p).keep("o_orderkey", "o_totalprice") for p in ((c("o_totalprice") < 100000.0) | (c("o_totalprice") >= 400000.0), c("o_totalprice").between(100000.0, 250000.0), c("o_totalprice").between(250000.0, 399999.0))]
    first = session(t)
    first.run(parts)
    sizes = [first.store.entries[first.planner.key(q)].pages for q in parts]
    s = session(t, sizes[0] + max(sizes[1:]))
    reports = s.run([parts[0], parts[1], parts[0], parts[2], parts[2], parts[0]])
    return _with_counts(s.query(parts[0]), reports)


@query("reuse_mixed_sql", "SELECT o_orderkey, c_name, 1 AS reused, 0 AS views, 1 AS joins, 0 AS rebuilt, 0 AS evicted FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000")
def _reuse_mixed(t):
    """SQL and algebra share the store: what one keeps the other reads."""
    s = session(t)
    q = O.join(C, c("o_custkey").eq(c("c_custkey"))).where(c("o_totalprice") > 350000.0).keep("o_orderkey", "c_name")
    reports = s.run(["SELECT c_name AS name, o_orderkey AS id FROM customer, orders WHERE 350000.0D < o_totalprice AND c_custkey = o_custkey", q])
    return _with_counts(s.query(q), reports)


@query("reuse_larger_join", "SELECT c_name, o_orderkey, l_linenumber, 0 AS reused, 1 AS views, 1 AS joins, 0 AS rebuilt, 0 AS evicted FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")
def _reuse_larger(t):
    """A kept join serves a larger one that was written in another order."""
    s = session(t)
    q = C.join(L, A.Lit(True).eq(A.Lit(True))).join(O, c("c_custkey").eq(c("o_custkey")) & c("l_orderkey").eq(c("o_orderkey"))).where(c("l_quantity") > 45.0).keep("c_name", "o_orderkey", "l_linenumber")
    reports = s.run([O.join(C, c("o_custkey").eq(c("c_custkey"))), q])
    return _with_counts(s.query(q), reports)


@query("reuse_project_rebuild", "SELECT * FROM orders")
def _reuse_project(t):
    """A base table is rebuilt from a projection, whose expression is inverted, and its complement."""
    s = session(t)
    s.run([O.select(o_orderkey=c("o_orderkey"), owed=-c("o_totalprice"), o_custkey=c("o_custkey"))], complements=True)
    s.planner.forget_table("orders")
    return s.query(O)


@query("reuse_evict", "SELECT *, 0 AS reused, 0 AS views, 0 AS joins, 1 AS rebuilt, 0 AS evicted FROM orders")
def _reuse_evict(t):
    """A base table is given up after its join and antijoin are kept, and a query that asks for it gets it rebuilt."""
    s = session(t)
    s.run([O.join(C, c("o_custkey").eq(c("c_custkey")))], complements=True)
    s.planner.forget_table("orders")
    return _with_counts(s.query(O), [s.step(O)[0]])


@query("distinct_algebra", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def _distinct_algebra(t):
    return t(A.Distinct(O.keep("o_orderpriority", "o_orderstatus")))


algebra("in_subquery_algebra", A.in_query(c("c_custkey"), O.where(c("o_totalprice") > 300000.0).keep("o_custkey"), "o_custkey", C).keep("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
algebra("scalar_subquery_algebra", A.with_scalar(P, P.select(p_other=c("p_size")).group((), mean=Agg("avg", c("p_other")))).where(c("p_size") > c("mean")).keep("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size > (SELECT avg(p_size) FROM part)")
algebra("date_interval_algebra", L.where((c("l_shipdate") <= fn("interval", fn("date", "1998-12-01"), "-'90' DAY")) & (c("l_shipdate") >= fn("interval", fn("date", "1997-12-31"), "'1' MONTH"))).keep("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY AND l_shipdate >= DATE '1997-12-31' + INTERVAL '1' MONTH")


_STAR = {"customer": ("c", "o_custkey = c_custkey"), "lineitem": ("l", "o_orderkey = l_orderkey")}


@query("workload_star", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _star(t):
    """Ten star joins over whole tables: a hub of the lines and their orders, a spoke exchanged each time; then groups over the last."""
    s = session(t, None)
    line = s.planner.tables["lineitem"].select(*(f"l_{x}" for x in ("orderkey", "linenumber", "partkey", "suppkey")))
    hub = line.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hub_id"), "o_orderstatus", "o_orderpriority", F.col("l_partkey").alias("hub_part"), F.col("l_suppkey").alias("hub_supplier"), F.col("o_custkey").alias("hub_customer"), F.col("l_orderkey").alias("hub_order"), F.dayofmonth("o_orderdate").alias("hub_day")
    )
    s.register("hub", hub, (("hub_id",),))
    spokes = {"part": t.part.select(F.col("p_partkey")), "customer": t.customer.select(F.col("c_custkey")), "supplier": t.supplier.select(F.col("s_suppkey")), "order": t.orders.select(F.col("o_orderkey")), "day": t.spark.range(1, 32).select(F.col("id").cast("int"))}
    for name, df in spokes.items():
        s.register(name, df.toDF(f"{name}_hub"), ((f"{name}_hub",),))
    work = star_workload("hub", list(spokes), 3, 10)
    last = work[-1].group((c("o_orderstatus"), c("o_orderpriority")), o_orderstatus=c("o_orderstatus"), o_orderpriority=c("o_orderpriority"), n=Agg("count"))
    s.run([*work, last])
    return s.query(last)


# the star-schema suite
_SSB = """WITH lineorder AS (
  SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
         CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS lo_orderdate, l_quantity AS lo_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS lo_extendedprice, CAST(round(l_discount * 100) AS INT) AS lo_discount,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS lo_revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dates AS (SELECT DISTINCT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS d_datekey, CAST(year(o_orderdate) AS INT) AS d_year,
         year(o_orderdate) * 100 + month(o_orderdate) AS d_yearmonthnum FROM orders),
cust AS (SELECT c_custkey, n_name AS c_nation, r_name AS c_region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
supp AS (SELECT s_suppkey, n_name AS s_nation, r_name AS s_region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT p_partkey, p_type AS p_category, p_brand AS p_brand1, p_brand AS p_mfgr, CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.6 AS DECIMAL(2,1)) AS p_cost FROM part)
"""
_FOUR = "FROM lineorder JOIN dates ON lo_orderdate = d_datekey JOIN parts ON lo_partkey = p_partkey JOIN supp ON lo_suppkey = s_suppkey"
_CUST = "FROM lineorder JOIN dates ON lo_orderdate = d_datekey JOIN cust ON lo_custkey = c_custkey JOIN supp ON lo_suppkey = s_suppkey"
_FIVE = f"{_FOUR} JOIN cust ON lo_custkey = c_custkey"
_REV = "CAST(sum(lo_revenue) AS DOUBLE) AS revenue"
_PROFIT = "CAST(sum(lo_revenue - p_cost) AS DOUBLE) AS profit"
_DISCOUNTED = "SELECT CAST(sum(lo_extendedprice * lo_discount) AS DOUBLE) AS revenue FROM lineorder JOIN dates ON lo_orderdate = d_datekey"

for _name, _text in {
    "probe": "SELECT lo_orderkey, lo_linenumber, d_datekey, lo_quantity FROM lineorder JOIN dates ON lo_orderdate = d_datekey WHERE d_year = 1997 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25",
    "q1_1": f"{_DISCOUNTED} WHERE d_year = 1997 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25",
    "q1_2": f"{_DISCOUNTED} WHERE d_yearmonthnum = 199801 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35",
    "q1_3": f"{_DISCOUNTED} WHERE d_year = 1998 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35",
    "q2_1": f"SELECT {_REV}, d_year, p_brand1 {_FOUR} WHERE p_category = 'PROMO' AND s_region = 'AMERICA' GROUP BY d_year, p_brand1 ORDER BY d_year, p_brand1",
    "q2_2": f"SELECT {_REV}, d_year, p_brand1 {_FOUR} WHERE p_brand1 BETWEEN 'Brand#2' AND 'Brand#4' AND s_region = 'ASIA' GROUP BY d_year, p_brand1",
    "q2_3": f"SELECT {_REV}, d_year, p_brand1 {_FOUR} WHERE p_brand1 = 'Brand#3' AND s_region = 'EUROPE' GROUP BY d_year, p_brand1",
    "q3_1": f"SELECT c_nation, s_nation, d_year, {_REV} {_CUST} WHERE c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1996 AND d_year <= 2000 GROUP BY c_nation, s_nation, d_year ORDER BY d_year, revenue DESC",
    "q3_2": f"SELECT c_nation, s_nation, d_year, {_REV} {_CUST} WHERE c_nation = 'NATION_7' AND s_region = 'EUROPE' AND d_year BETWEEN 1996 AND 2000 GROUP BY c_nation, s_nation, d_year",
    "q3_3": f"SELECT c_nation, s_nation, d_year, {_REV} {_CUST} WHERE (c_nation = 'NATION_1' OR c_nation = 'NATION_5') AND (s_nation = 'NATION_2' OR s_nation = 'NATION_3' OR s_nation = 'NATION_8') AND d_year BETWEEN 1995 AND 2001 GROUP BY c_nation, s_nation, d_year",
    "q3_4": f"SELECT c_nation, s_nation, d_year, {_REV} {_CUST} WHERE (c_nation = 'NATION_1' OR c_nation = 'NATION_5') AND (s_region = 'ASIA' OR s_region = 'AFRICA') AND d_yearmonthnum = 199712 GROUP BY c_nation, s_nation, d_year",
    "q4_1": f"SELECT d_year, c_nation, {_PROFIT} {_FIVE} WHERE c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'Brand#1' OR p_mfgr = 'Brand#2') GROUP BY d_year, c_nation ORDER BY d_year, c_nation",
    "q4_2": f"SELECT d_year, s_nation, p_category, {_PROFIT} {_FIVE} WHERE c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1997 OR d_year = 1998) GROUP BY d_year, s_nation, p_category",
    "q4_3": f"SELECT d_year, s_nation, p_brand1, {_PROFIT} {_FIVE} WHERE s_region = 'ASIA' AND (d_year = 1997 OR d_year = 1998) AND p_category = 'SMALL' GROUP BY d_year, s_nation, p_brand1",
    "stress_a": "SELECT lo_orderkey, lo_linenumber, d_year, s_nation FROM lineorder JOIN dates ON lo_orderdate = d_datekey JOIN supp ON lo_suppkey = s_suppkey",
    "stress_b": "SELECT lo_orderkey, lo_linenumber, d_year, c_nation FROM lineorder JOIN dates ON lo_orderdate = d_datekey JOIN cust ON lo_custkey = c_custkey",
}.items():
    sql_query(f"ssb_{_name}", _SSB + _text)


def ssb_session(t: Tables, share: float | None, names: tuple[str, ...]) -> tuple[Session, list]:
    """A session with the star-schema queries run in order, under a share of the base tables' pages."""
    s = session(t)
    if share is not None:
        s.store.budget = int(share * sum(s.planner.table_pages[n] for n in ("lineitem", "orders", "customer", "supplier", "part")))
    return s, [s.step(_ORACLE[f"ssb_{n}"])[0] for n in names]


#: The workload of 30 queries that alternates between two joins of three tables, and each query of the suite twice.
ALTERNATING = ("stress_a", "stress_b") * 15
SUITE = tuple(n.removeprefix("ssb_") for n in _ORACLE if n.startswith("ssb_")) * 2


def _counts_sql(names: tuple[str, ...]) -> str:
    counted = "\nUNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM ({_ORACLE[f'ssb_{n}']}) AS q" for n in sorted(set(names)))
    steps = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"SELECT step, s.name, n FROM (VALUES {steps}) AS s(step, name) JOIN ({counted}) AS c ON s.name = c.name"


for _kind, _names, _share in (("alternating", ALTERNATING, None), ("alternating", ALTERNATING, 0.5), ("alternating", ALTERNATING, 0.1), ("suite", SUITE, None), ("suite", SUITE, 0.5)):
    _label = {None: "unlimited", 0.5: "half", 0.1: "tenth"}[_share]

    @query(f"ssb_workload_{_kind}_{_label}", _counts_sql(_names))
    def _ssb_workload(t, names=_names, share=_share):
        _, reports = ssb_session(t, share, names)
        return t.spark.createDataFrame([(i, n, r.rows) for i, (n, r) in enumerate(zip(names, reports, strict=True))], "step int, name string, n long")

# TPC-H-like
_EXT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_DISC = f"{_EXT} * (1 - CAST(l_discount AS DECIMAL(4,2)))"
for _name, _text in {
    "q1": f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum({_EXT}) AS DOUBLE) AS sum_base, CAST(sum({_DISC}) AS DOUBLE) AS sum_disc, CAST(sum({_DISC} * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus",
    "q3": f"SELECT l_orderkey, CAST(sum({_DISC}) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY o_orderpriority",
    "q5": f"SELECT n_name, CAST(sum({_DISC}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "q6": f"SELECT CAST(sum({_EXT} * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "q7": f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, CAST(sum({_DISC}) AS DOUBLE) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3') GROUP BY n1.n_name, n2.n_name, year(l_shipdate)",
    "q8": f"SELECT CAST(year(o_orderdate) AS INT) AS o_year, CAST(sum(CASE WHEN n2.n_name = 'NATION_3' THEN {_DISC} ELSE 0 END) AS DOUBLE) AS national, CAST(sum({_DISC}) AS DOUBLE) AS everything FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY year(o_orderdate)",
    "q10": f"SELECT c_custkey, c_name, CAST(sum({_DISC}) AS DOUBLE) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1997-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "q12": "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_linestatus",
    "q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) c_orders GROUP BY c_count",
    "q14": f"SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_DISC} ELSE 0 END) AS DOUBLE) / CAST(sum({_DISC}) AS DOUBLE), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-09-01' + INTERVAL '1' MONTH",
    "q15": f"WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({_DISC}) AS total FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, CAST(total AS DOUBLE) AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM revenue)",
    "q17": f"SELECT round(CAST(sum({_EXT}) AS DOUBLE) / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    "q18": "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "q19": f"SELECT CAST(sum({_DISC}) AS DOUBLE) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)",
    "q21": "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name",
    "q22": "SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY c_nationkey",
}.items():
    sql_query(f"tpch_{_name}", _text)

for _name in [n for n in _ORACLE if n.startswith("tpch_")]:
    # the same texts through a session: parsed to the algebra, kept, and read back
    query(f"session_{_name}", _ORACLE[_name])(lambda t, name=_name: session(t).step(_ORACLE[name])[1])
