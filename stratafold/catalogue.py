"""Queries over the test tables, one for each operator the engine offers, and SQL with the same results.

Relational queries are one text for both sides: `lake.` names our space, and is left out for the reference database. Others run statements of
the engine (views, policies, row changes, publishing, search, graphs) and come with SQL of their own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import asof_join, range_join
from .session import Engine, Session

Query = Callable[[SparkSession, str], DataFrame]

#: Queries whose text is the same on both sides.
SQL: dict[str, str] = {}

SQL["q1_pricing_summary"] = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lake.lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
SQL["q2_supplier_star"] = """
SELECT s_acctbal, s_name, n_name, p_partkey, p_type
FROM lake.part, lake.supplier, (SELECT DISTINCT l_partkey, l_suppkey FROM lake.lineitem) AS ps, lake.nation, lake.region
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND p_type LIKE 'PROMO%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"""
SQL["q3_shipping_priority"] = """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM lake.customer, lake.orders, lake.lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
SQL["q4_order_priority"] = """
SELECT o_orderpriority, count(*) AS order_count FROM lake.orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM lake.lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority"""
SQL["q5_local_supplier"] = """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lake.customer, lake.orders, lake.lineitem, lake.supplier, lake.nation, lake.region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC"""
SQL |= {
    "scan_project": "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 + 1 AS twice FROM lake.customer",
    "scan_constant": "SELECT 40 + 2 AS answer",
    "filter_pred": "SELECT o_orderkey, o_totalprice FROM lake.orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority = '1-URGENT'",
    "like_filter": "SELECT p_partkey, p_name FROM lake.part WHERE p_type LIKE 'ECO%' OR p_name LIKE '%1'",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size FROM lake.orders",
    "cast_literals": "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderdate AS DATE) AS day, o_orderdate >= DATE '1997-01-01' AS late, o_orderkey::VARCHAR AS text FROM lake.orders WHERE abs(o_totalprice - floor(o_totalprice) - 0.5) > 0.01 AND o_totalprice - floor(o_totalprice) < 0.5",
    "null_predicates": "SELECT c.c_custkey, o.o_orderkey IS NULL AS without FROM lake.customer c LEFT JOIN (SELECT * FROM lake.orders WHERE o_totalprice > 150000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_orderdate IS NOT NULL",
    "join_inner": "SELECT c_name, o_orderkey, o_totalprice FROM lake.customer JOIN lake.orders ON c_custkey = o_custkey WHERE o_totalprice > 100000",
    "join_comma": "SELECT n_name, r_name FROM lake.nation, lake.region WHERE n_regionkey = r_regionkey",
    "join_star": "SELECT n_name, p_brand, count(*) AS lines FROM lake.lineitem JOIN lake.supplier ON l_suppkey = s_suppkey JOIN lake.nation ON s_nationkey = n_nationkey JOIN lake.part ON l_partkey = p_partkey GROUP BY n_name, p_brand",
    "join_left": "SELECT n_name, s_name FROM lake.nation LEFT JOIN lake.supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_right": "SELECT s_name, n_name FROM lake.supplier RIGHT JOIN lake.nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM lake.nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM lake.nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM lake.region a CROSS JOIN lake.region b",
    "join_on_true": "SELECT a.r_name AS a, b.n_name AS b FROM lake.region a JOIN lake.nation b ON true",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM lake.nation a JOIN lake.nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": "SELECT c_custkey FROM lake.customer WHERE EXISTS (SELECT 1 FROM lake.orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "join_anti": "SELECT c_custkey FROM lake.customer WHERE NOT EXISTS (SELECT 1 FROM lake.orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_not_in": "SELECT p_partkey FROM lake.part WHERE p_partkey NOT IN (SELECT l_partkey FROM lake.lineitem WHERE l_quantity > 48 AND l_discount > 0.08)",
    "join_in_subquery": "SELECT s_suppkey FROM lake.supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lake.lineitem WHERE l_quantity > 45)",
    "join_using": "SELECT n_regionkey, count(*) AS pairs FROM lake.nation a JOIN lake.nation b USING (n_regionkey) GROUP BY n_regionkey",
    "join_natural": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM lake.nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM lake.supplier) y",
    "lateral_subquery": "SELECT n_name, t.best FROM lake.nation, LATERAL (SELECT max(s_acctbal) AS best FROM lake.supplier WHERE s_nationkey = n_nationkey) t",
    "agg_grouped": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM lake.orders GROUP BY o_orderstatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lake.lineitem GROUP BY l_returnflag",
    "agg_global": "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lake.lineitem",
    "agg_expression": "SELECT l_orderkey % 10 AS digit, count(*) AS n FROM lake.lineitem GROUP BY l_orderkey % 10",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM lake.orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_minmax": "SELECT o_orderpriority, min(o_orderdate) AS first, max(o_orderdate) AS last, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice / 1000), 4) AS variance, round(corr(o_totalprice, o_orderkey), 6) AS r FROM lake.orders GROUP BY o_orderpriority",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n FROM lake.orders GROUP BY o_orderstatus",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM lake.orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_rollup": "SELECT r_name, n_name, count(*) AS n FROM lake.nation JOIN lake.region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lake.lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lake.lineitem",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS middle FROM lake.lineitem GROUP BY l_returnflag",
    "win_rank": "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM lake.orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM lake.events",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n FROM lake.orders",
    "win_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lake.lineitem",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS quarter FROM lake.customer",
    "win_first_last": "SELECT event_id, first_value(event_type) OVER w AS first, last_value(event_type) OVER w AS last, nth_value(event_type, 2) OVER w AS second FROM lake.events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_qualify": "SELECT o_custkey, o_orderkey FROM lake.orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "sort_multi": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM lake.orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM lake.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM lake.orders ORDER BY o_orderkey LIMIT 20 OFFSET 30",
    "union_distinct": "SELECT c_nationkey AS k FROM lake.customer UNION SELECT s_nationkey FROM lake.supplier",
    "union_all": "SELECT c_nationkey AS k FROM lake.customer UNION ALL SELECT s_nationkey FROM lake.supplier",
    "union_all_limit": "SELECT k FROM (SELECT c_custkey AS k FROM lake.customer UNION ALL SELECT s_suppkey FROM lake.supplier) t ORDER BY k LIMIT 15",
    "union_aggregate": "SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM lake.customer UNION SELECT s_nationkey FROM lake.supplier) t",
    "intersect": "SELECT c_nationkey AS k FROM lake.customer INTERSECT SELECT s_nationkey FROM lake.supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM lake.customer INTERSECT ALL SELECT s_nationkey FROM lake.supplier",
    "except": "SELECT n_nationkey AS k FROM lake.nation EXCEPT SELECT s_nationkey FROM lake.supplier WHERE s_acctbal > 3000",
    "except_all": "SELECT c_nationkey AS k FROM lake.customer EXCEPT ALL SELECT s_nationkey FROM lake.supplier",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INT) AS n, substring(p_name, 2, 3) AS s, p_name || '-' || p_brand AS c, replace(p_name, 'a', 'b') AS r, trim('  x ') AS t, reverse(p_type) AS v, lpad(p_brand, 12, '*') AS p, CAST(levenshtein(p_type, 'PROMO') AS INT) AS e FROM lake.part",
    "fn_regex": "SELECT p_partkey, regexp_extract(p_name, '([0-9]+)', 1) AS digits FROM lake.part",
    "fn_date": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later FROM lake.orders",
    "fn_math": "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, round(sqrt(l_quantity), 8) AS q, round(ln(l_quantity), 8) AS n, round(power(l_quantity, 2), 4) AS p, l_orderkey % 7 AS m FROM lake.lineitem",
    "fn_conditional": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0.0) AS owed, least(c_acctbal, 100.0) AS low FROM lake.customer",
    "fn_crypto": "SELECT p_partkey, md5(p_name) AS m FROM lake.part",
    "cte_nested": "WITH big AS (SELECT * FROM lake.orders WHERE o_totalprice > 100000), counts AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM counts GROUP BY n",
    "derived_table": "SELECT s.n, count(*) AS m FROM (SELECT o_custkey, count(*) AS n FROM (SELECT * FROM lake.orders WHERE o_orderstatus <> 'P') o GROUP BY o_custkey) s GROUP BY s.n",
    "scalar_subquery": "SELECT o_orderkey FROM lake.orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.7 FROM lake.orders)",
    "name_requalified": "SELECT lake.nation.n_name AS nation, lake.region.r_name AS region FROM lake.nation, lake.region WHERE lake.nation.n_regionkey = lake.region.r_regionkey AND lake.region.r_regionkey > 1",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
}
#: Where the two sides spell it differently: ours, and the reference database's.
PAIRS: dict[str, tuple[str, str]] = {
    "agg_collect": (
        "SELECT r_name, array_join(array_sort(collect_list(n_name)), ',') AS nations FROM lake.nation JOIN lake.region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "scan_generate": ("SELECT unnest(range(300)) AS i", "SELECT unnest(range(300)) AS i"),
    "scan_table_functions": ("SELECT id FROM range(60) WHERE id % 7 = 1", "SELECT range AS id FROM range(60) WHERE range % 7 = 1"),
    "fn_array": (
        "SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first, round(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE)), 6) AS total, array_contains(array(label, 7), 7) AS seven, size(array_distinct(array(label, label, 3))) AS kinds FROM lake.embeddings",
        "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, list_contains([label, 7], 7) AS seven, len(list_distinct([label, label, 3]))::INTEGER AS kinds FROM embeddings",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM lake.events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "fn_map": (
        "SELECT r_regionkey, element_at(map(1, r_name, 2, 'x'), 1) AS name, size(map_keys(map(1, 'a', 2, 'b'))) AS n FROM lake.region",
        "SELECT r_regionkey, r_name AS name, 2::INTEGER AS n FROM region",
    ),
    "fn_encode": (
        "SELECT r_regionkey, base64(CAST(r_name AS BINARY)) AS b, sha2(r_name, 256) AS s, hex(CAST(r_name AS BINARY)) AS h FROM lake.region",
        "SELECT r_regionkey, base64(encode(r_name)) AS b, sha256(r_name) AS s, hex(encode(r_name)) AS h FROM region",
    ),
    "time_tumbling": (
        "SELECT window(CAST(ts AS TIMESTAMP), '1 hour').start::TIMESTAMP_NTZ AS hour, event_type, count(*) AS n FROM lake.events GROUP BY window(CAST(ts AS TIMESTAMP), '1 hour'), event_type",
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}


def lake(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the test tables as the space `lake`."""
    engine = Engine(spark)
    engine.attach_files("lake", sf_dir)
    return engine.session()


def _text(sql: str) -> Query:
    return lambda spark, sf_dir: lake(spark, sf_dir).sql(sql).frame


QUERIES: dict[str, Query] = {n: _text(t) for n, t in SQL.items()} | {n: _text(a) for n, (a, _) in PAIRS.items()}
ORACLES: dict[str, str] = {n: t.replace("lake.", "") for n, t in SQL.items()} | {n: b for n, (_, b) in PAIRS.items()}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Joins without a Spark operator


@query("SELECT a.event_id, b.o_orderkey AS r_o_orderkey FROM events a ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) b ON a.user_id = b.o_custkey AND a.ts >= b.o_orderdate")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    right = s.sql("SELECT o_custkey AS user_id, max(o_orderkey) AS o_orderkey, o_orderdate AS ts FROM lake.orders GROUP BY o_custkey, o_orderdate").frame
    return asof_join(s.table("lake.events"), right, ["user_id"], "ts").select("event_id", "r_o_orderkey")


@query("SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey AND p_size <= n_nationkey + 3")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    bounds = s.sql("SELECT n_nationkey, n_nationkey AS low, n_nationkey + 3 AS high FROM lake.nation").frame
    return range_join(s.table("lake.part"), bounds, "p_size", "low", "high", 4).select("p_partkey", "n_nationkey")


@query("SELECT l_returnflag, true AS near, quantile_disc(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts, held against exact ones within three times their standard error, and an approximate median, whose rank is within 1/100000 of a group's rows.

    Exact counts stand apart: beside them, Spark would keep sketches for every value they count, in place of a few for a group.
    """
    return lake(spark, sf_dir).sql("""
        SELECT a.l_returnflag, abs(a.about / e.parts - 1) < 0.09 AS near, a.middle
        FROM (SELECT l_returnflag, approx_count_distinct(l_partkey, 0.03) AS about, percentile_approx(l_quantity, 0.5, 100000) AS middle FROM lake.lineitem GROUP BY l_returnflag) a
        JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lake.lineitem GROUP BY l_returnflag) e ON a.l_returnflag <=> e.l_returnflag""").frame


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s")
def time_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lake(spark, sf_dir).table("lake.events").withColumn("t", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("t", "1 day")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


# The semantic layer


def _guarded(spark: SparkSession, sf_dir: str, *statements: str) -> tuple[Session, Session]:
    """The owner's session after some statements, and one of alice's."""
    owner = lake(spark, sf_dir)
    for s in statements:
        owner.sql(s)
    return owner, owner.engine.session("alice")


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON c_custkey = o_custkey GROUP BY c_mktsegment")
def sem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, _ = _guarded(spark, sf_dir, "CREATE VIEW lake.big AS SELECT * FROM lake.orders WHERE o_totalprice > 100000", "CREATE VIEW lake.buyers AS SELECT c_mktsegment, o_orderkey FROM lake.customer JOIN lake.big ON c_custkey = o_custkey")
    return owner.sql("SELECT c_mktsegment, count(*) AS n FROM lake.buyers GROUP BY c_mktsegment").frame


@query("SELECT c_custkey, c_name FROM customer")
def sem_column_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, alice = _guarded(spark, sf_dir, "GRANT SELECT (c_custkey, c_name) ON lake.customer TO alice")
    return alice.sql("SELECT * FROM lake.customer").frame


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 150000")
def sem_row_policy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, alice = _guarded(spark, sf_dir, "GRANT SELECT ON lake.orders TO alice", "CREATE POLICY a ON lake.orders TO alice, bob USING (o_orderstatus = 'F')", "CREATE POLICY b ON lake.orders TO alice USING (o_totalprice > 150000)", "CREATE POLICY c ON lake.orders TO bob USING (true)")
    return alice.sql("SELECT o_orderkey FROM lake.orders").frame


@query("SELECT count(*) AS n FROM orders WHERE false")
def sem_policy_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, alice = _guarded(spark, sf_dir, "GRANT SELECT ON lake.orders TO alice", "CREATE POLICY c ON lake.orders TO bob USING (true)")
    return alice.sql("SELECT count(*) AS n FROM lake.orders").frame


@query("SELECT c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def sem_current_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, _ = _guarded(spark, sf_dir, "CREATE POLICY own ON lake.customer TO 'x' USING (c_name = current_user)")
    who = owner.sql("SELECT min(c_name) AS m FROM lake.customer").collect()[0].m
    for s in (f"GRANT SELECT ON lake.customer TO '{who}'", f"CREATE POLICY mine ON lake.customer TO '{who}' USING (c_name = current_user)"):
        owner.sql(s)
    return owner.engine.session(who).sql("SELECT c_custkey FROM lake.customer").frame


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
def sem_owner_rights_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, alice = _guarded(spark, sf_dir, "CREATE VIEW lake.counts AS SELECT o_custkey, count(*) AS n FROM lake.orders WHERE o_totalprice > 100000 GROUP BY o_custkey", "GRANT SELECT ON lake.counts TO alice")
    return alice.sql("SELECT * FROM lake.counts").frame


# Storage: a root of its own for each query


def _root(spark: SparkSession, sf_dir: str) -> Session:
    """A session on a fresh root, with the test tables attached."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = f"{shared.rstrip('/')}/stratafold-root-{_fresh()}" if shared else tempfile.mkdtemp(prefix="stratafold-")
    engine = Engine(spark, root)
    atexit.register(_drop, engine)
    engine.attach_files("lake", sf_dir)
    return engine.session()


def _drop(engine: Engine) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        engine.fs.delete(engine.root)


def _fresh() -> str:
    return uuid.uuid4().hex[:12]


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::DOUBLE AS extra FROM nation")
def dml_insert_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.n (id BIGINT NOT NULL, name VARCHAR, extra DOUBLE); INSERT INTO ice.n (NAME, id) SELECT n_name, n_nationkey FROM lake.nation")
    return s.sql("SELECT * FROM ice.n").frame


def _versioned(spark: SparkSession, sf_dir: str) -> Session:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE v WITH FORMAT = 'versioned'; CREATE TABLE v.n AS SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM lake.nation")
    return s


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name, n_regionkey AS region FROM nation")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.sql("UPDATE v.n SET name = upper(name) || '!' WHERE region = 1")
    return s.sql("SELECT * FROM v.n").frame


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 3 <> 0")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.sql("DELETE FROM v.n WHERE id % 3 = 0")
    return s.sql("SELECT * FROM v.n").frame


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'merged' ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region WHERE r_regionkey = 4")
def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.sql("""MERGE INTO v.n t USING (SELECT n_nationkey AS id, n_regionkey AS region FROM lake.nation WHERE n_regionkey IN (2, 3) UNION ALL SELECT 100 + r_regionkey, r_regionkey FROM lake.region WHERE r_regionkey = 4) s ON t.id = s.id
             WHEN MATCHED AND s.region = 3 THEN DELETE WHEN MATCHED THEN UPDATE SET name = 'merged' WHEN NOT MATCHED THEN INSERT (id, name, region) VALUES (s.id, 'MIDDLE EAST', s.region)""")
    return s.sql("SELECT * FROM v.n").frame.withColumn("name", F.when(F.col("id") >= 100, F.col("name")).otherwise(F.col("name")))


@query("SELECT c_custkey AS id FROM customer")
def dml_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.c (id BIGINT)")
    for k in range(3):
        s.sql(f"INSERT INTO ice.c SELECT c_custkey FROM lake.customer WHERE c_custkey % 3 = {k}")
    s.compact("ice.c")
    return s.sql("SELECT * FROM ice.c").frame


@query("SELECT r_regionkey::BIGINT AS id FROM region WHERE r_regionkey < 3")
def dml_time_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.r (id BIGINT); INSERT INTO ice.r SELECT r_regionkey FROM lake.region WHERE r_regionkey < 3")
    pin = s._log("ice", "r").snapshot().id
    s.sql("INSERT INTO ice.r SELECT r_regionkey FROM lake.region WHERE r_regionkey >= 3")
    return s.table("ice.r", snapshot_id=pin)


@query("SELECT n_nationkey AS id, n_name AS label, 'new' AS note FROM nation")
def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("ALTER TABLE v.n ADD COLUMN note VARCHAR; ALTER TABLE v.n RENAME COLUMN name TO label; ALTER TABLE v.n DROP COLUMN region; UPDATE v.n SET note = 'new'")
    return s.sql("SELECT * FROM v.n").frame


def _with_store(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the nations in a row store."""
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE shop WITH KIND = 'transactional'; CREATE TABLE shop.nation (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER)")
    s.load("shop.nation", s.sql("SELECT n_nationkey, n_name, n_regionkey FROM lake.nation").frame)
    return s


@query("SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def fed_rowstore_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_store(spark, sf_dir).sql("SELECT name, count(*) AS n FROM shop.nation JOIN lake.customer ON id = c_nationkey GROUP BY name").frame


@query("SELECT a.n_name AS a, r_name AS b FROM nation a JOIN region ON n_regionkey = r_regionkey")
def fed_same_engine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE one; CREATE SPACE two; CREATE TABLE one.t (id BIGINT, name VARCHAR); CREATE TABLE two.t (id BIGINT, name VARCHAR); INSERT INTO one.t SELECT n_regionkey, n_name FROM lake.nation; INSERT INTO two.t SELECT r_regionkey, r_name FROM lake.region")
    return s.sql("SELECT x.name AS a, y.name AS b FROM one.t x JOIN two.t y ON x.id = y.id").frame


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey <> 5")
def tx_commit_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.script("SET SPACE shop; BEGIN; DELETE FROM nation WHERE id = 5; COMMIT; BEGIN; DELETE FROM nation; ROLLBACK")
    return s.sql("SELECT * FROM nation").frame


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def publish_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.sql("PUBLISH SPACE shop")
    return s.sql("SELECT * FROM shop_published.nation").frame


def _two_roots(spark: SparkSession, sf_dir: str, mode: str) -> Session:
    """A second root that mounts a space of the first."""
    owner, guest = _with_store(spark, sf_dir), _root(spark, sf_dir)
    owner.sql("PUBLISH SPACE shop")
    did = guest.sql("SHOW IDENTITY").collect()[0].did
    token = owner.sql(f"ISSUE UCAN ON SPACE shop_published TO '{did}' CAN 'space/read' EXPIRES IN 1h").collect()[0].token
    owner.sql(f"GRANT SELECT ON shop_published.nation TO '{did}'")
    guest.sql(f"CREATE SPACE far WITH TOKEN = '{token}', PEER = '{owner.engine.root}', REMOTE = 'shop_published', MODE = '{mode}'")
    return guest


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def refresh_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    guest = _two_roots(spark, sf_dir, "replica")
    guest.sql("REFRESH SPACE far")
    return guest.sql("SELECT * FROM far.nation").frame


@query("SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def fed_remote_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_roots(spark, sf_dir, "query").sql("SELECT name, count(*) AS n FROM far.nation JOIN lake.customer ON id = c_nationkey GROUP BY name").frame


# Search


def _first_vector(spark: SparkSession, sf_dir: str) -> str:
    row = lake(spark, sf_dir).sql("SELECT embedding FROM lake.embeddings WHERE vec_id = 0").collect()[0]
    return "[" + ", ".join(repr(float(x)) for x in row.embedding) + "]::FLOAT[64]"


_NEAR = "SELECT vec_id FROM (SELECT vec_id, {} AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) {}) ORDER BY d, vec_id LIMIT {}"


@query(_NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 10))
def vec_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).sql(f"SELECT vec_id FROM lance_vector_search(lake.embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 10)").frame


@query(_NEAR.format("list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 10))
def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).sql(f"SELECT vec_id FROM vector_search(lake.embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 10, metric => 'cosine')").frame


@query("SELECT vec_id FROM (" + _NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 50).replace("SELECT vec_id FROM (SELECT vec_id,", "SELECT vec_id, label FROM (SELECT vec_id, label,") + ") WHERE label = 1")
def vec_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).sql(f"SELECT vec_id FROM vector_search(lake.embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 50) WHERE label = 1").frame


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t(i, term) AS (VALUES (1, 'idiot'), (2, 'license'), (3, 'rights')),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t),
df AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
FROM f JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id"""


@query(_BM25 + " ORDER BY score DESC, doc_id LIMIT 20")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.search import bm25

    return bm25(lake(spark, sf_dir).table("lake.documents"), ["text"], "idiot license rights").select("doc_id", F.round("_score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


@query(_BM25.replace("SELECT doc_id, round(", "SELECT doc_id FROM (SELECT doc_id, round(") + ")")
def fts_any_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.search import bm25

    return bm25(lake(spark, sf_dir).table("lake.documents"), ["text"], "idiot OR license OR rights").select("doc_id")


_HYBRID = f"""
WITH both_of AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT doc_id, row_number() OVER (ORDER BY list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::FLOAT, doc_id) AS r FROM both_of, q),
d AS (SELECT doc_id, {_WORDS} AS w FROM both_of), t(term) AS (VALUES ('license'), ('rights')), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t), df AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term),
scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 9) AS score FROM f JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id),
best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, round(coalesce(1 / (60 + near.r), 0) + coalesce(1 / (60 + best.r), 0), 9) AS score FROM near FULL JOIN best USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""


@query(_HYBRID)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    s.sql("CREATE VIEW lake.both AS SELECT doc_id, text, embedding FROM lake.documents JOIN lake.embeddings ON doc_id = vec_id")
    return s.sql(f"SELECT doc_id, round(_hybrid_score, 9) AS score FROM lance_hybrid_search(lake.both, 'embedding', {_first_vector(spark, sf_dir)}, 'text', 'license rights', k => 10)").frame


_PART_WORD = "SELECT p_partkey AS rowid FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])' || (SELECT split_part(lower(min(p_name)), ' ', 1) FROM part) || '([^a-z0-9]|$)')"


def _notes(spark: SparkSession, sf_dir: str) -> tuple[Session, str]:
    """A session with the parts' names in a row store, a full-text table over them, and a word of theirs."""
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE shop WITH KIND = 'transactional'; CREATE TABLE shop.notes (id INTEGER PRIMARY KEY, body TEXT); CREATE VIRTUAL TABLE shop.docs USING fts5(body, content = 'notes', content_rowid = 'id')")
    s.load("shop.notes", s.sql("SELECT p_partkey, p_name FROM lake.part").frame)
    s.sql("INSERT INTO shop.docs(docs) VALUES('rebuild')")
    return s, s.sql("SELECT split(lower(min(p_name)), ' ')[0] AS w FROM lake.part").collect()[0].w


@query(_PART_WORD)
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, word = _notes(spark, sf_dir)
    return s.sql(f"SELECT rowid FROM shop.docs WHERE docs MATCH '{word}' ORDER BY bm25(docs)").frame


# Graphs

_EDGES = "(SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01')"


def _trade(spark: SparkSession, sf_dir: str) -> Session:
    """A graph of customers and suppliers who traded in a quarter."""
    s = lake(spark, sf_dir)
    s.sql("CREATE VIEW lake.trades AS SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lake.orders JOIN lake.lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'")
    s.sql("CREATE VIEW lake.follows AS SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM lake.nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM lake.nation WHERE n_nationkey % 2 = 0")
    s.sql("CREATE PROPERTY GRAPH lake.trade VERTEX TABLES (customer LABEL buyer, supplier LABEL seller) EDGE TABLES (trades SOURCE KEY (c) REFERENCES customer (c_custkey) DESTINATION KEY (s) REFERENCES supplier (s_suppkey) LABEL bought)")
    s.sql("CREATE PROPERTY GRAPH lake.ring VERTEX TABLES (nation LABEL land) EDGE TABLES (follows SOURCE KEY (a) REFERENCES nation (n_nationkey) DESTINATION KEY (b) REFERENCES nation (n_nationkey) LABEL next)")
    return s


@query(f"SELECT c_name AS buyer, s_name AS seller FROM {_EDGES} e JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey WHERE c_mktsegment = 'BUILDING'")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.trade MATCH (a:buyer WHERE a.c_mktsegment = 'BUILDING')-[k:bought]->(b:seller) COLUMNS (a.c_name AS buyer, b.s_name AS seller)) ORDER BY buyer, seller").frame


@query(f"SELECT x.c AS a, y.c AS b, x.s FROM {_EDGES} x JOIN {_EDGES} y ON x.s = y.s JOIN customer ca ON ca.c_custkey = x.c WHERE ca.c_mktsegment = 'MACHINERY'")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.trade MATCH (a:buyer WHERE a.c_mktsegment = 'MACHINERY')-[k:bought]->(m:seller)<-[l:bought]-(b:buyer) COLUMNS (a.c_custkey AS a, b.c_custkey AS b, m.s_suppkey AS s))").frame


# The same matches on the whole graph, tested on a small one by brute force. Pairs over hub vertices and paths grow too fast for SQL to compare with.


def _whole_trade(spark: SparkSession, sf_dir: str) -> Session:
    """The graph of all customers and suppliers who ever traded: from buyers to sellers, and as parties that reach each other."""
    s = lake(spark, sf_dir)
    s.sql("CREATE VIEW lake.trades AS SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lake.orders JOIN lake.lineitem ON o_orderkey = l_orderkey")
    s.sql("CREATE VIEW lake.parties AS SELECT 2 * c_custkey AS id, c_name AS name FROM lake.customer UNION ALL SELECT 2 * s_suppkey + 1, s_name FROM lake.supplier")
    s.sql("CREATE VIEW lake.deals AS SELECT 2 * c AS a, 2 * s + 1 AS b FROM lake.trades UNION ALL SELECT 2 * s + 1, 2 * c FROM lake.trades")
    s.sql("CREATE PROPERTY GRAPH lake.trade VERTEX TABLES (customer LABEL buyer, supplier LABEL seller) EDGE TABLES (trades SOURCE KEY (c) REFERENCES customer (c_custkey) DESTINATION KEY (s) REFERENCES supplier (s_suppkey) LABEL bought)")
    s.sql("CREATE PROPERTY GRAPH lake.market VERTEX TABLES (parties LABEL party) EDGE TABLES (deals SOURCE KEY (a) REFERENCES parties (id) DESTINATION KEY (b) REFERENCES parties (id) LABEL dealt)")
    return s


@query("SELECT DISTINCT c_name AS buyer, s_name AS seller FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
def graph_edges_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.trade MATCH (a:buyer)-[k:bought]->(b:seller) COLUMNS (a.c_name AS buyer, b.s_name AS seller))").frame


@query()
def graph_two_hop_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.trade MATCH (a:buyer)-[k:bought]->(m:seller)<-[l:bought]-(b:buyer) COLUMNS (a.c_custkey AS a, b.c_custkey AS b, m.s_suppkey AS s))").frame


@query()
def graph_any_shortest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first customer (id 2) to all parties, itself by way of another."""
    return _whole_trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.market MATCH p = ANY SHORTEST (a:party WHERE a.id = 2)-[k:dealt]->+(b:party) COLUMNS (b.name AS target, path_length(p) AS hops))").frame


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.ring MATCH (a:land WHERE a.n_regionkey = 2) COLUMNS (a.n_name AS name))").frame


_RING = "SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 2 = 0"


@query(f"WITH RECURSIVE e AS ({_RING}), r(t, d) AS (SELECT b, 1 FROM e WHERE a = 0 UNION SELECT e.b, d + 1 FROM r JOIN e ON r.t = e.a WHERE d < 26) SELECT n_name AS target, min(d)::INTEGER AS hops FROM r JOIN nation ON t = n_nationkey GROUP BY n_name")
def graph_any_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.ring MATCH p = ANY SHORTEST (a:land WHERE a.n_nationkey = 0)-[k:next]->+(b:land) COLUMNS (b.n_name AS target, path_length(p) AS hops))").frame
