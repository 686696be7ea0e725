"""More queries of the catalogue: statements that make, change and guard what is queried, each with SQL that gives the same rows.

Rules are shown as tables of cases and outcomes: `ok`, or the kind of error that a statement must end in.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capability
from .catalogue import _BM25, _NEAR, _PART_WORD, _RING, _first_vector, _fresh, _notes, _root, _trade, _two_roots, _versioned, _with_store, lake, query
from .errors import EngineError
from .plans.lexer import split_script
from .session import Engine, Session
from .sources.snapshots import Table
from .streaming.tables import append_stream, windowed_counts


def _values(names: str, rows: list[tuple]) -> str:
    """The rows as SQL."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def _outcome(run) -> str:
    try:
        run()
    except EngineError as e:
        return type(e).__name__
    return "ok"


def _outcomes(s: Session, cases: list[tuple[str, str]]) -> DataFrame:
    """What becomes of each statement."""
    return s.spark.createDataFrame([(name, _outcome(lambda sql=sql: s.sql(sql))) for name, sql in cases], "rule string, outcome string")


def rules(expected: dict[str, str]):
    """A query of cases and their outcomes, which must be these."""
    return query(_values("rule, outcome", list(expected.items())))


# Scans and names


@query("SELECT 0::BIGINT AS n, NULL::BIGINT AS top, NULL::VARCHAR AS word")
def scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.e (id BIGINT NOT NULL, word VARCHAR, day DATE)")
    return s.sql("SELECT count(*) AS n, max(id) AS top, min(word) AS word FROM ice.e").frame


@query("SELECT label, count(*) AS n FROM nation JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS r(k, label) ON n_regionkey = k GROUP BY label")
def scan_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    s.engine.attach_memory("held", {"labels": pa.table({"k": [0, 1, 2], "label": ["zero", "one", "two"]})})
    return s.sql("SELECT label, count(*) AS n FROM lake.nation JOIN held.labels ON n_regionkey = k GROUP BY label").frame


@query(_values("version, operation, files", [(1, "create", 0), (2, "append", 1), (3, "append", 2), (4, "update", 2)]))
def scan_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE v WITH FORMAT = 'versioned'; CREATE TABLE v.r (id BIGINT)")
    for k in range(2):
        s.load("v.r", s.sql(f"SELECT CAST(r_regionkey + {10 * k} AS BIGINT) AS id FROM lake.region").frame.coalesce(1))
    s.sql("UPDATE v.r SET id = -1 WHERE id = 3")
    table = s._log("v", "r")
    return spark.createDataFrame([(x.version, x.operation, len(table.files(x))) for x in table.history()], "version int, operation string, files int")


@query(_values("name", [(n,) for n in "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()] + [("whales",)]))
def scan_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    s.sql("CREATE VIEW lake.whales AS SELECT c_custkey FROM lake.customer WHERE c_acctbal > 9000")
    return spark.createDataFrame([(n,) for n in s.relations("lake")], "name string")


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def scan_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.sql("CREATE SPACE ice")
    s.register("ice.nation", f"{sf_dir}/nation.parquet")
    return s.sql("SELECT n_regionkey AS k, count(*) AS n FROM ice.nation GROUP BY n_regionkey").frame


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def name_default_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    s.sql("SET SPACE lake")
    return s.sql("SELECT n_name FROM nation WHERE n_regionkey = 1").frame


@query("SELECT true AS scans, true AS pushed, true AS columns")
def explain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.col("plan")
    return lake(spark, sf_dir).sql("EXPLAIN SELECT o_orderkey FROM lake.orders WHERE o_totalprice > 1000").frame.select(plan.contains("Scan parquet").alias("scans"), plan.contains("GreaterThan(o_totalprice,1000.0)").alias("pushed"), plan.contains("ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>").alias("columns"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).sql("SELECT o_orderkey FROM lake.orders WHERE o_totalprice > ? AND o_orderstatus = ?", [250000, "F"]).frame


@query(_values("name, type", [("o_orderkey", "bigint"), ("half", "double"), ("day", "date")]))
def limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = lake(spark, sf_dir).sql("SELECT o_orderkey, o_totalprice / 2 AS half, CAST(o_orderdate AS DATE) AS day FROM lake.orders LIMIT 0").frame
    assert probe.isEmpty()
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in probe.schema.fields], "name string, type string")


# Rows and tables that change


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
def dml_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.r (id BIGINT, name VARCHAR)")
    s.load("ice.r", s.sql("SELECT r_regionkey, r_name FROM lake.region").frame)
    return s.sql("SELECT * FROM ice.r").frame


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 0 THEN 100 ELSE n_regionkey END AS region FROM nation WHERE n_regionkey < 2 OR n_nationkey % 2 = 0")
def dml_merge_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.sql("""MERGE INTO v.n t USING (SELECT n_nationkey AS id FROM lake.nation WHERE n_regionkey < 2) s ON t.id = s.id WHEN MATCHED AND t.region = 0 THEN UPDATE SET region = 100 WHEN MATCHED THEN DO NOTHING
             WHEN NOT MATCHED BY SOURCE AND t.id % 2 = 1 THEN DELETE""")
    return s.sql("SELECT * FROM v.n").frame


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 3")
def dml_insert_from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("CREATE VIEW v.third AS SELECT id FROM v.n WHERE region = 3; CREATE TABLE v.copy (id INT); INSERT INTO v.copy SELECT id FROM v.third")
    return s.sql("SELECT id FROM v.copy").frame


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 4")
def ddl_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("GRANT SELECT ON v.n TO alice; CREATE POLICY p ON v.n TO alice USING (region = 4); ALTER TABLE v.n RENAME TO lands")
    return s.engine.session("alice").sql("SELECT * FROM v.lands").frame


@rules({"before": "ok", "drop": "ok", "drop again": "NotFound", "drop if there": "ok", "read": "NotFound", "grant is gone": "NotFound", "two spaces": "Unsupported"})
def ddl_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.x (a INT); CREATE TABLE v.x (a INT); GRANT SELECT ON v.n TO alice")
    first = _outcomes(s, [("before", "SELECT * FROM v.n"), ("drop", "DROP TABLE v.n"), ("drop again", "DROP TABLE v.n"), ("drop if there", "DROP TABLE IF EXISTS v.n"), ("read", "SELECT * FROM v.n"), ("two spaces", "DROP TABLE v.x, ice.x")])
    return first.unionAll(_outcomes(s.engine.session("alice"), [("grant is gone", "SELECT * FROM v.n")]))


@rules({"drop": "ok", "read": "NotFound", "name is free again": "InvalidProperty", "bind its location": "ok", "rows are there": "ok", "unknown": "NotFound"})
def ddl_drop_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    return _outcomes(s, [("drop", "DROP SPACE v"), ("read", "SELECT * FROM v.n"), ("name is free again", "CREATE SPACE v"), ("bind its location", "CREATE SPACE w WITH LOCATION = 'v'"), ("rows are there", "SELECT * FROM w.n"), ("unknown", "DROP SPACE nowhere")])


@rules({"make": "ok", "make again": "AlreadyExists", "replace": "ok", "name of a table": "AlreadyExists", "unknown column": "InvalidStatement", "reads itself": "InvalidStatement", "columns": "Unsupported", "granted": "ok", "drop": "ok", "drop again": "NotFound", "drop if there": "ok", "read": "NotFound"})
def ddl_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    return _outcomes(s, [
        ("make", "CREATE VIEW lake.big AS SELECT * FROM lake.orders WHERE o_totalprice > 1"), ("make again", "CREATE VIEW lake.big AS SELECT 1 AS a"), ("replace", "CREATE OR REPLACE VIEW lake.big AS SELECT o_orderkey FROM lake.orders"), ("name of a table", "CREATE VIEW lake.orders AS SELECT 1 AS a"),
        ("unknown column", "CREATE VIEW lake.other AS SELECT depth FROM lake.orders"), ("reads itself", "CREATE OR REPLACE VIEW lake.big AS SELECT o_orderkey FROM lake.big"), ("columns", "CREATE VIEW lake.c (a) AS SELECT 1"), ("granted", "GRANT SELECT ON lake.big TO alice"),
        ("drop", "DROP VIEW lake.big"), ("drop again", "DROP VIEW lake.big"), ("drop if there", "DROP VIEW IF EXISTS lake.big"), ("read", "SELECT * FROM lake.big"),
    ])


@rules({"update": "Unsupported", "delete": "Unsupported", "merge": "Unsupported", "alter": "Unsupported", "create as": "Unsupported", "nested": "Unsupported", "row store from elsewhere": "Unsupported", "row store merge": "Unsupported", "delete over two spaces": "Unsupported", "read-only": "AccessDenied", "missing column": "ConformError", "missing table": "NotFound"})
def rules_of_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.t (id INT NOT NULL, name VARCHAR); CREATE SPACE v WITH FORMAT = 'versioned'; CREATE TABLE v.t (id INT)")
    return _outcomes(s, [
        ("update", "UPDATE ice.t SET id = 1"), ("delete", "DELETE FROM ice.t"), ("merge", "MERGE INTO ice.t t USING (SELECT 1 AS id) o ON t.id = o.id WHEN MATCHED THEN DELETE"), ("alter", "ALTER TABLE ice.t ADD COLUMN x INT"), ("create as", "CREATE TABLE ice.u AS SELECT 1 AS a"), ("nested", "CREATE TABLE ice.u (a STRUCT(b INT))"),
        ("row store from elsewhere", "INSERT INTO shop.nation SELECT * FROM lake.nation"), ("row store merge", "MERGE INTO shop.nation t USING (SELECT 1 AS id) o ON t.id = o.id WHEN MATCHED THEN DELETE"), ("delete over two spaces", "DELETE FROM v.t WHERE id IN (SELECT id FROM ice.t)"),
        ("read-only", "INSERT INTO lake.nation SELECT * FROM lake.nation"), ("missing column", "INSERT INTO ice.t (name) VALUES ('x')"), ("missing table", "INSERT INTO ice.u VALUES (1)"),
    ])


@rules({"two statements": "InvalidStatement", "none": "InvalidStatement", "show tables": "Unsupported", "create schema": "Unsupported", "explain a change": "Unsupported", "set a variable": "Unsupported", "no space": "InvalidStatement", "three parts": "InvalidStatement", "strings hold semicolons": "ok", "comments too": "ok"})
def rules_of_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(lake(spark, sf_dir), [
        ("two statements", "SELECT 1; SELECT 2"), ("none", " ; "), ("show tables", "SHOW TABLES"), ("create schema", "CREATE SCHEMA x"), ("explain a change", "EXPLAIN DROP TABLE lake.nation"), ("set a variable", "SET x = 1"), ("no space", "SELECT * FROM nation"), ("three parts", "SELECT * FROM a.lake.nation"),
        ("strings hold semicolons", "SELECT ';' AS s FROM lake.region"), ("comments too", "SELECT 1 AS a /* ; */ -- ;\n;"),
    ])


@query(_values("nth, statement", [(0, "SELECT ';'"), (1, 'SELECT "a;b"'), (2, "SELECT 3")]))
def script_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(split_script("SELECT ';' ;; SELECT \"a;b\"; SELECT 3 ;"))), "nth int, statement string")


@rules({"storage": "InvalidProperty", "location": "NotFound", "property": "InvalidProperty", "kind": "InvalidProperty", "read-only row store": "InvalidProperty", "format of a row store": "InvalidProperty", "again": "AlreadyExists", "second writer": "InvalidProperty", "reader": "ok", "row store for a table space": "InvalidProperty", "without a token": "InvalidProperty", "name": "InvalidProperty"})
def rules_of_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.sql("CREATE SPACE ice")
    return _outcomes(s, [
        ("storage", "CREATE SPACE x WITH STORAGE = 'stone'"), ("location", "CREATE SPACE x WITH LOCATION = 'lost'"), ("property", "CREATE SPACE x WITH HUE = 'red'"), ("kind", "CREATE SPACE x WITH KIND = 'odd'"), ("read-only row store", "CREATE SPACE x WITH KIND = 'transactional', ACCESS = 'ro'"),
        ("format of a row store", "CREATE SPACE x WITH KIND = 'transactional', FORMAT = 'lance'"), ("again", "CREATE SPACE ice"), ("second writer", "CREATE SPACE x WITH LOCATION = 'ice', ACCESS = 'rw'"), ("reader", "CREATE SPACE x WITH LOCATION = 'ice'"),
        ("row store for a table space", "CREATE SPACE y WITH KIND = 'transactional', LOCATION = 'ice'"), ("without a token", "CREATE SPACE y WITH KIND = 'remote'"), ("name", "CREATE SPACE \"a b\""),
    ])


# Guards


@rules({"insert": "AccessDenied", "create": "AccessDenied", "drop": "AccessDenied", "grant": "AccessDenied", "publish": "AccessDenied", "search": "AccessDenied", "graph": "AccessDenied", "not granted": "NotFound", "not there": "NotFound", "granted": "ok", "explain": "ok", "default space": "ok", "hidden space": "NotFound"})
def rules_of_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _trade(spark, sf_dir)
    s.sql("GRANT SELECT ON lake.nation TO alice")
    return _outcomes(s.engine.session("alice"), [
        ("insert", "INSERT INTO lake.nation VALUES (1)"), ("create", "CREATE SPACE x"), ("drop", "DROP TABLE lake.nation"), ("grant", "GRANT SELECT ON lake.orders TO alice"), ("publish", "PUBLISH SPACE lake"), ("search", "SELECT * FROM lance_fts(lake.documents, 'text', 'x')"),
        ("graph", "FROM GRAPH_TABLE (lake.ring MATCH (a:land) COLUMNS (a.n_name))"), ("not granted", "SELECT * FROM lake.orders"), ("not there", "SELECT * FROM lake.rivers"), ("granted", "SELECT n_name FROM lake.nation"), ("explain", "EXPLAIN SELECT n_name FROM lake.nation"), ("default space", "SET SPACE lake"), ("hidden space", "SET SPACE sea"),
    ])


@query("SELECT 'granted' AS step, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'by the policy', (SELECT count(*) FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'policy dropped', (SELECT count(*) FROM nation) UNION ALL SELECT 'revoked', -1")
def sem_revoke_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    alice, steps = s.engine.session("alice"), []
    for step, sql in (("granted", "GRANT SELECT ON lake.nation TO alice"), ("by the policy", "CREATE POLICY p ON lake.nation TO alice USING (n_regionkey = 1)"), ("policy dropped", "DROP POLICY p ON lake.nation"), ("revoked", "REVOKE SELECT ON lake.nation FROM alice")):
        s.sql(sql)
        try:
            steps.append((step, alice.sql("SELECT count(*) AS n FROM lake.nation").collect()[0].n))
        except EngineError:
            steps.append((step, -1))
    return spark.createDataFrame(steps, "step string, n bigint")


_TOKENS = [("space/read", "a", "space/query", "a", True), ("space/query", "a", "space/read", "a", False), ("space/*", "*", "space/read", "b", True), ("space/read", "a", "space/read", "b", False), ("space/read", "team/*", "space/read", "team/x", True), ("space/read", "team/*", "space/read", "teams", False)]


@query(_values("held, on_space, wanted, at_space, covered", _TOKENS))
def token_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(*r[:4], capability.covers(r[:2], r[2:4])) for r in _TOKENS], "held string, on_space string, wanted string, at_space string, covered boolean")


@query(_values("text, seconds", [("30", 30), ("15m", 900), ("2 hours", 7200), ("1d", 86400), ("366d", 31622400), ("367d", None), ("0", None), ("3 moons", None)]))
def token_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def seconds(text: str) -> int | None:
        try:
            return capability.duration(text)
        except EngineError:
            return None

    return spark.createDataFrame([(t, seconds(t)) for t in ("30", "15m", "2 hours", "1d", "366d", "367d", "0", "3 moons")], "text string, seconds int")


@rules({"holds": "ok", "delegated": "ok", "wider than its proof": "AccessDenied", "for another": "AccessDenied", "too late": "AccessDenied", "too early": "AccessDenied", "revoked proof": "AccessDenied", "changed": "AccessDenied", "unknown issuer": "AccessDenied", "request": "ok", "request again": "AccessDenied", "request for other bytes": "AccessDenied"})
def token_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (capability.Identity(k * 32) for k in (b"a", b"b", b"c"))
    keys, verify = {i.did: i.key for i in (a, b, c)}, capability.verify
    first = capability.issue(a, b.did, [("space/read", "*")], 100, now=1000)
    second, wide = (capability.issue(b, c.did, [(x, "lake")], 50, proof=first, now=1000) for x in ("space/query", "space/*"))
    gate, ask = capability.Gate(), capability.sign_request(c, "query", b"SELECT 1", second, 1010)
    cases = [
        ("holds", lambda: verify(first, b.did, keys, now=1010)), ("delegated", lambda: verify(second, c.did, keys, now=1010)), ("wider than its proof", lambda: verify(wide, c.did, keys, now=1010)), ("for another", lambda: verify(first, c.did, keys, now=1010)), ("too late", lambda: verify(first, b.did, keys, now=1161)),
        ("too early", lambda: verify(first, b.did, keys, now=939)), ("revoked proof", lambda: verify(second, c.did, keys, {capability.token_id(first)}, now=1010)), ("changed", lambda: verify(first[:-1] + ("0" if first[-1] != "0" else "1"), b.did, keys, now=1010)), ("unknown issuer", lambda: verify(first, b.did, {b.did: b.key}, now=1010)),
        ("request", lambda: gate.check("query", b"SELECT 1", ask, keys, now=1011)), ("request again", lambda: gate.check("query", b"SELECT 1", ask, keys, now=1012)), ("request for other bytes", lambda: gate.check("query", b"SELECT 2", ask, keys, now=1012)),
    ]
    return spark.createDataFrame([(n, _outcome(f)) for n, f in cases], "rule string, outcome string")


# Spaces together


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def fed_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_store(spark, sf_dir).sql("SELECT o.name FROM shop.nation o WHERE o.region = 2 AND o.id > 8").frame


@query("SELECT count(*) AS n, count(DISTINCT k) AS kinds FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer)")
def fed_union_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_store(spark, sf_dir).sql("SELECT count(*) AS n, count(DISTINCT k) AS kinds FROM (SELECT region AS k FROM shop.nation UNION ALL SELECT c_nationkey FROM lake.customer)").frame


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_versioned_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.r (id INT, label VARCHAR); INSERT INTO ice.r SELECT r_regionkey, r_name FROM lake.region")
    return s.sql("SELECT n.name, r.label AS region FROM v.n n JOIN ice.r r ON n.region = r.id").frame


@query("SELECT 5::BIGINT AS before, 10::BIGINT AS after, 25::BIGINT AS pairs")
def fed_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement reads one snapshot of a table, however often it names it, and keeps it."""
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.r (id BIGINT); INSERT INTO ice.r SELECT r_regionkey FROM lake.region")
    before, pairs = s.sql("SELECT count(*) AS before FROM ice.r").frame, s.sql("SELECT count(*) AS pairs FROM ice.r a JOIN ice.r b ON true").frame
    s.sql("INSERT INTO ice.r SELECT r_regionkey + 5 FROM lake.region")
    after = s.sql("SELECT count(*) AS after FROM ice.r").frame
    return spark.createDataFrame([(before.collect()[0][0], after.collect()[0][0], pairs.collect()[0][0])], "before bigint, after bigint, pairs bigint")


@query("SELECT 'ROMANIA' AS name, 7.5::DOUBLE AS depth")
def fed_table_made_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.sql("SELECT count(*) FROM shop.nation").collect()
    s.script("DROP TABLE shop.nation; CREATE TABLE shop.nation (name TEXT, depth REAL); INSERT INTO shop.nation VALUES ('ROMANIA', 7.5)")
    return s.sql("SELECT * FROM shop.nation").frame


@query(_values("capabilities, revoked", [("space/read on shop_published", True), ("space/query on *", False)]))
def tokens_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.sql("PUBLISH SPACE shop")
    first = s.sql("ISSUE UCAN ON SPACE shop_published TO 'did:key:x' CAN 'space/read' EXPIRES IN 1h").collect()[0]
    s.sql("ISSUE UCAN ON SPACE * TO 'did:key:y' EXPIRES IN 2 days")
    assert [s.sql(f"REVOKE UCAN '{i}'").rows_affected for i in (first.id, first.id, "none")] == [1, 0, 0]
    return s.sql("SHOW UCANS").frame.select("capabilities", "revoked")


@query("SELECT 1::BIGINT AS peers, true AS reached, true AS seen")
def peers_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_roots(spark, sf_dir, "query").sql("SHOW PEERS").frame.agg(F.count("*").alias("peers"), F.bool_and(F.col("endpoint").isNotNull()).alias("reached"), F.bool_and(F.col("last_seen_ms") > 0).alias("seen"))


# Publishing


@query("SELECT 'nation' AS relation, (SELECT count(*) FROM nation) AS n")
def publish_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.script("CREATE TABLE shop.other (a INTEGER); PUBLISH SPACE shop TABLES (nation) TO show")
    (name,) = s.relations("show")
    return s.sql(f"SELECT '{name}' AS relation, count(*) AS n FROM show.{name}").frame


@rules({"publish": "ok", "insert": "AccessDenied", "create": "AccessDenied", "drop": "AccessDenied", "into another": "AccessDenied", "of no row store": "Unsupported", "unknown table": "EngineError", "read": "ok"})
def publish_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.sql("CREATE SPACE ice")
    return _outcomes(s, [("publish", "PUBLISH SPACE shop"), ("insert", "INSERT INTO shop_published.nation VALUES (1, 'x', 1)"), ("create", "CREATE TABLE shop_published.t (a INT)"), ("drop", "DROP TABLE shop_published.nation"), ("into another", "PUBLISH SPACE shop TO ice"), ("of no row store", "PUBLISH SPACE ice"), ("unknown table", "PUBLISH SPACE shop TABLES (rivers)"), ("read", "SELECT * FROM shop_published.nation")])


@query("SELECT count(*) AS n FROM nation WHERE n_nationkey > 3")
def publish_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_store(spark, sf_dir)
    s.script("PUBLISH SPACE shop; DELETE FROM shop.nation WHERE id <= 3")
    s.publish_every(3600, "PUBLISH SPACE shop").stop()  # it runs at once
    return s.sql("SELECT count(*) AS n FROM shop_published.nation").frame


@query(_values("step, name, status", [(0, "nation", "current"), (0, "secret", "restricted"), (1, "nation", "updated"), (1, "secret", "restricted"), (2, "nation", "current"), (2, "secret", "restricted")]))
def refresh_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted tables are reported and not copied; others are copied where they changed."""
    owner, guest = _with_store(spark, sf_dir), _root(spark, sf_dir)
    owner.script("CREATE TABLE shop.secret (a INTEGER, b TEXT); PUBLISH SPACE shop")
    did = guest.sql("SHOW IDENTITY").collect()[0].did
    token = owner.sql(f"ISSUE UCAN ON SPACE shop_published TO '{did}' CAN 'space/read' EXPIRES IN 1h").collect()[0].token
    owner.script(f"GRANT SELECT ON shop_published.nation TO '{did}'; GRANT SELECT (a) ON shop_published.secret TO '{did}'")
    guest.sql(f"CREATE SPACE far WITH TOKEN = '{token}', PEER = '{owner.engine.root}', REMOTE = 'shop_published', MODE = 'replica'")
    steps = []
    for step in range(3):
        if step == 1:
            owner.script("DELETE FROM shop.nation WHERE id = 0; PUBLISH SPACE shop")
        steps += [(step, r["table"], r.status) for r in guest.sql("REFRESH SPACE far").collect()]
    return spark.createDataFrame(steps, "step int, name string, status string")


# Search


@query("SELECT vec_id, lang FROM (" + _NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 40) + ") JOIN documents ON vec_id = doc_id")
def join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).sql(f"SELECT v.vec_id, d.lang FROM lance_vector_search(lake.embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 40) v JOIN lake.documents d ON v.vec_id = d.doc_id").frame


@query(_NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 5))
def search_bound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lake(spark, sf_dir)
    s.sql("SET SPACE lake")
    return s.sql(f"SELECT vec_id FROM vector_search(embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 5)").frame


def _copied(spark: SparkSession, sf_dir: str, name: str) -> Session:
    s = _root(spark, sf_dir)
    s.script(f"CREATE SPACE v WITH FORMAT = 'versioned'; CREATE TABLE v.{name} AS SELECT * FROM lake.{name}")
    return s


@query(_BM25 + " ORDER BY score DESC, doc_id LIMIT 20")
def fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir, "documents")
    s.sql("CREATE INDEX words ON v.documents USING INVERTED (text)")
    return s.sql("SELECT doc_id, round(_score, 6) AS score FROM lance_fts(v.documents, 'text', 'idiot license rights', k => 20)").frame


@query(_NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 10))
def vec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _copied(spark, sf_dir, "embeddings")
    s.sql("CREATE INDEX near ON v.embeddings USING IVF_FLAT (embedding) WITH (metric_type = 'l2')")
    return s.sql(f"SELECT vec_id FROM lance_vector_search(v.embeddings, 'embedding', {_first_vector(spark, sf_dir)}, k => 10)").frame


@rules({"make": "ok", "again": "AlreadyExists", "search with it": "ok", "unknown type": "Unsupported", "two columns": "Unsupported", "unknown column": "NotFound", "drop": "ok", "drop again": "NotFound", "if exists": "Unsupported", "snapshot table": "Unsupported", "search without": "ok"})
def rules_of_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.t (id INT)")
    find = "SELECT * FROM lance_fts(v.n, 'name', 'china')"
    return _outcomes(s, [("make", "CREATE INDEX w ON v.n USING INVERTED (name)"), ("again", "CREATE INDEX w ON v.n USING BTREE (id)"), ("search with it", find), ("unknown type", "CREATE INDEX x ON v.n USING RTREE (id)"), ("two columns", "CREATE INDEX x ON v.n USING BTREE (id, name)"), ("unknown column", "CREATE INDEX x ON v.n USING BTREE (depth)"), ("drop", "DROP INDEX w ON v.n"), ("drop again", "DROP INDEX w ON v.n"), ("if exists", "DROP INDEX IF EXISTS w ON v.n"), ("snapshot table", "CREATE INDEX x ON ice.t USING BTREE (id)"), ("search without", find)])


@rules({"snapshot table": "Unsupported", "two spaces": "Unsupported", "a string for a table": "InvalidStatement", "no words": "InvalidStatement", "unknown argument": "InvalidStatement", "match in a lake": "Unsupported", "no vector": "InvalidStatement"})
def rules_of_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.t (id INT, text VARCHAR)")
    return _outcomes(s, [("snapshot table", "SELECT * FROM lance_fts(ice.t, 'text', 'x')"), ("two spaces", "SELECT * FROM lance_fts(v.n, 'name', 'china') f JOIN ice.t ON f.id = t.id"), ("a string for a table", "SELECT * FROM lance_fts('v.n', 'name', 'x')"), ("no words", "SELECT * FROM lance_fts(v.n, 'name', '..')"), ("unknown argument", "SELECT * FROM lance_fts(v.n, 'name', 'x', depth => 3)"), ("match in a lake", "SELECT * FROM lake.nation WHERE n_name MATCH 'x'"), ("no vector", "SELECT * FROM lance_vector_search(v.n, 'id', 'near')")])


@query(_PART_WORD.replace("SELECT p_partkey AS rowid", "SELECT count(*) AS n") + " AND p_partkey % 2 = 1")
def fts_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of content that lies elsewhere, what was there when the table was built is found."""
    s, word = _notes(spark, sf_dir)
    s.script("DELETE FROM shop.notes WHERE id % 2 = 0; INSERT INTO shop.docs(docs) VALUES('rebuild')")
    return s.sql(f"SELECT count(*) AS n FROM shop.docs WHERE docs MATCH '{word}'").frame


@query(_values("name", [("docs",), ("notes",)]))
def fts_hidden_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _notes(spark, sf_dir)
    return spark.createDataFrame([(n,) for n in s.relations("shop")], "name string")


@query(_NEAR.format("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "", 10).replace("SELECT vec_id FROM (", "SELECT vec_id AS rowid FROM (", 1))
def vec0_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE shop WITH KIND = 'transactional'; CREATE VIRTUAL TABLE shop.vecs USING vec0(embedding float[64])")
    s.load("shop.vecs", s.sql("SELECT vec_id, to_json(embedding) AS embedding FROM lake.embeddings").frame)
    first = json.dumps([float(x) for x in s.sql("SELECT embedding FROM lake.embeddings WHERE vec_id = 0").collect()[0].embedding])
    return s.sql(f"SELECT rowid FROM shop.vecs WHERE embedding MATCH '{first}' AND k = 10 ORDER BY distance").frame


@query("SELECT 1::BIGINT AS kept, 1.0::DOUBLE AS away")
def tx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _root(spark, sf_dir)
    s.script("""CREATE SPACE shop WITH KIND = 'transactional'; CREATE VIRTUAL TABLE shop.dots USING vec0(at float[2]); SET SPACE shop; BEGIN; INSERT INTO dots(rowid, at) VALUES (1, '[0, 1]'); COMMIT;
        BEGIN; INSERT INTO dots(rowid, at) VALUES (2, '[0, 0]'); ROLLBACK""")
    return s.sql("SELECT count(*) AS kept, CAST(min(distance) AS DOUBLE) AS away FROM dots WHERE at MATCH '[0, 0]' AND k = 5").frame


# Graphs


@query(f"WITH RECURSIVE e AS ({_RING}), r(t, d) AS (SELECT 0, 0 UNION SELECT e.b, d + 1 FROM r JOIN e ON r.t = e.a WHERE d < 26) SELECT n_name AS target, min(d)::INTEGER AS hops FROM r JOIN nation ON t = n_nationkey GROUP BY n_name")
def graph_any_shortest_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).sql("FROM GRAPH_TABLE (lake.ring MATCH p = ANY SHORTEST (a:land WHERE a.n_nationkey = 0)-[k:next]->*(b:land) COLUMNS (b.n_name AS target, path_length(p) AS hops))").frame


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey WHERE a.n_nationkey <> 7")
def graph_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that another session of the root defined, over the tables as they are now."""
    s = _versioned(spark, sf_dir)
    s.sql("CREATE PROPERTY GRAPH v.g VERTEX TABLES (n LABEL land) EDGE TABLES (n SOURCE KEY (id) REFERENCES n (id) DESTINATION KEY (region) REFERENCES n (id) LABEL points)")
    s.sql("DELETE FROM v.n WHERE id = 7")
    return Engine(spark, s.engine.root).session().sql("FROM GRAPH_TABLE (v.g MATCH (a:land)-[e:points]->(b:land) COLUMNS (a.name AS a, b.name AS b))").frame


@rules({"again": "AlreadyExists", "if not there": "ok", "replace": "ok", "unknown table": "NotFound", "unknown key": "NotFound", "other space": "Unsupported", "unknown label": "NotFound", "repeated without shortest": "InvalidStatement", "with another space": "Unsupported", "drop": "ok", "drop again": "NotFound", "drop if there": "ok", "read": "NotFound"})
def rules_of_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _versioned(spark, sf_dir)
    body = "v.g VERTEX TABLES (n LABEL land) EDGE TABLES (n SOURCE KEY (id) REFERENCES n (id) DESTINATION KEY (region) REFERENCES n (id) LABEL points)"
    s.sql(f"CREATE PROPERTY GRAPH {body}")
    return _outcomes(s, [
        ("again", f"CREATE PROPERTY GRAPH {body}"), ("if not there", f"CREATE PROPERTY GRAPH IF NOT EXISTS {body}"), ("replace", f"CREATE OR REPLACE PROPERTY GRAPH {body}"), ("unknown table", "CREATE PROPERTY GRAPH v.h VERTEX TABLES (rivers)"), ("unknown key", f"CREATE PROPERTY GRAPH {body.replace('v.g', 'v.h').replace('(region)', '(depth)')}"),
        ("other space", "CREATE PROPERTY GRAPH v.h VERTEX TABLES (lake.nation)"), ("unknown label", "FROM GRAPH_TABLE (v.g MATCH (a:river) COLUMNS (a.id))"), ("repeated without shortest", "FROM GRAPH_TABLE (v.g MATCH (a:land)-[e:points]->+(b:land) COLUMNS (a.id))"),
        ("with another space", "SELECT * FROM GRAPH_TABLE (v.g MATCH (a:land) COLUMNS (a.id)) g JOIN lake.nation ON id = n_nationkey"), ("drop", "DROP PROPERTY GRAPH v.g"), ("drop again", "DROP PROPERTY GRAPH v.g"), ("drop if there", "DROP PROPERTY GRAPH IF EXISTS v.g"), ("read", "FROM GRAPH_TABLE (v.g MATCH (a:land) COLUMNS (a.id))"),
    ])


# Streams


def _feed(spark: SparkSession, sf_dir: str):
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a table, each batch once, also when it comes again."""
    s = _root(spark, sf_dir)
    s.script("CREATE SPACE ice; CREATE TABLE ice.events (event_id BIGINT, event_type VARCHAR)")
    table = s._log("ice", "events")
    append_stream(_feed(spark, sf_dir).select("event_id", "event_type"), table, f"feed-{_fresh()}", f"{s.engine.root}/checkpoint").awaitTermination(120)
    (name,) = table.snapshot().streams
    table.append_batch(table.frame(), name, 0)
    return s.sql("SELECT event_type, count(*) AS n FROM ice.events GROUP BY event_type").frame


@query("SELECT w AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type FROM events) WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY w, event_type")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are final, as the newest event is a day behind them."""
    table = Table(spark, f"{_root(spark, sf_dir).engine.root}/windows")
    events = _feed(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = windowed_counts(events, "ts", ["event_type"], "6 hours", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    table.create(counts.schema)
    append_stream(counts, table, f"windows-{_fresh()}", f"{table.path}-checkpoint").awaitTermination(120)
    return table.frame()


