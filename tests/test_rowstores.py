"""Row stores: what reaches them, transactions, and their search tables."""

from __future__ import annotations

import pytest
from stratafold.errors import EngineError, InvalidStatement, Unsupported
from stratafold.session import open_session
from stratafold.sources.rowstore import RowStore

from .harbour import VISITS, harbour, rows


@pytest.fixture
def s(spark, tmp_path):
    return harbour(open_session(spark, str(tmp_path / "root")))


@pytest.fixture
def asked(monkeypatch):
    """The statements with which tables are read."""
    seen, read = [], RowStore.read

    def record(self, sql, kinds, names, connection=None, args=()):
        seen.append((sql.replace('"', ""), tuple(args)))
        return read(self, sql, kinds, names, connection, args)

    monkeypatch.setattr(RowStore, "read", record)
    return seen


@pytest.mark.parametrize(
    ("sql", "statements"),
    [
        ("SELECT berth FROM quay.visits WHERE hours > 10 AND no <> 6", [("SELECT no, berth, hours FROM visits WHERE (hours IS NOT NULL) AND (no IS NOT NULL) AND (hours > ?) AND (NOT (no = ?))", (10.0, 6))]),
        ("SELECT count(*) FROM quay.visits", [("SELECT no FROM visits", ())]),
        ("SELECT name, sum(hours) FROM port.ships JOIN quay.visits USING (imo) WHERE berth IN ('east', 'west') OR paid GROUP BY name", None),
        ("SELECT a.no FROM quay.visits a JOIN quay.visits b ON a.imo = b.imo AND a.berth = 'deep' AND b.hours < 30", None),
        ("SELECT no FROM quay.visits WHERE upper(berth) = 'EAST' AND imo = 101 AND paid", None),
        ("SELECT no FROM (SELECT no, rank() OVER (ORDER BY hours DESC) AS r FROM quay.visits) WHERE r = 1", [("SELECT no, hours FROM visits", ())]),
        ("SELECT no FROM quay.visits WHERE paid IS NULL OR NOT paid ORDER BY no", [("SELECT no, paid FROM visits WHERE ((paid IS NULL) OR (NOT (paid <> 0)))", ())]),
    ],
)
def test_columns_and_conditions_reach_the_store(s, asked, sql, statements):
    got = sorted(rows(s, sql), key=str)
    if statements is not None:
        assert asked == statements
    elif "a.no" in sql:
        assert [a for _, a in asked] == [("deep",), (30.0,)] and all("hours" not in q.split("FROM")[0] or "b" for q, _ in asked)
    elif "upper" in sql:
        assert len(asked) == 1 and asked[0][1] == (101,) and "upper" not in asked[0][0].lower().split("where")[1] and "(paid <> 0)" in asked[0][0]
    # The same from whole tables that Spark filters.
    held = s.spark.createDataFrame(VISITS, "no bigint, imo bigint, berth string, hours double, paid boolean")
    s.engine.attach_memory("plain", {"visits": held})
    assert got == sorted(rows(s, sql.replace("quay.", "plain.")), key=str) and len(got) > 0


def test_nothing_is_read_for_names_and_grants(s, asked):
    s.script("GRANT SELECT (no, hours) ON quay.visits TO kim; CREATE VIEW quay.long AS SELECT no FROM quay.visits WHERE hours > 5; CREATE POLICY p ON quay.visits TO kim USING (paid)")
    assert asked == []
    assert rows(s.engine.session("kim"), "SELECT no FROM quay.visits WHERE hours < 2") == [(5,)]
    assert len(asked) == 1 and "(paid <> 0)" in asked[0][0] and asked[0][1] == (2.0,)


def test_transactions(s):
    with pytest.raises(Unsupported):
        s.sql("BEGIN")
    s.script("SET SPACE quay; BEGIN; UPDATE visits SET paid = true WHERE berth = 'deep'; INSERT INTO visits VALUES (8, 106, 'deep', 2.5, false)")
    count = "SELECT count(*) FROM quay.visits v JOIN port.ships h ON v.imo = h.imo WHERE NOT v.paid"
    other = s.engine.session()
    assert rows(s, count) == [(1,)] and rows(other, count) == [(1,)] and rows(s, "SELECT max(no) FROM visits") == [(8,)] and rows(other, "SELECT max(no) FROM quay.visits") == [(7,)]
    with pytest.raises(InvalidStatement):
        s.sql("BEGIN")
    s.sql("ROLLBACK")
    assert rows(s, "SELECT max(no) FROM visits") == [(7,)]
    with pytest.raises(InvalidStatement):
        s.sql("ROLLBACK")
    s.script("BEGIN TRANSACTION; DELETE FROM visits WHERE no = 7; COMMIT")
    assert rows(other, "SELECT max(no) FROM quay.visits") == [(6,)]
    assert s.sql("UPDATE quay.visits SET hours = hours * 2 WHERE berth = 'east'").rows_affected == 2
    for refused in ("DELETE FROM quay.visits WHERE imo IN (SELECT imo FROM port.ships)", "MERGE INTO quay.visits t USING (SELECT 1 AS k) o ON t.no = o.k WHEN MATCHED THEN DELETE", "INSERT INTO quay.visits SELECT * FROM port.ships"):
        with pytest.raises(Unsupported):
            s.sql(refused)
    with pytest.raises(EngineError):
        s.sql("INSERT INTO quay.visits VALUES (1, 1, 'x', 1.0, true)")


def test_rows_are_loaded_with_any_text(s):
    s.sql("CREATE TABLE quay.words (no INTEGER, said TEXT)")
    said = ["it's", '"; DROP TABLE words; --', None, "é\n日本"]
    assert s.load("quay.words", s.spark.createDataFrame(list(enumerate(said)), "no int, said string")) == 4
    assert [r[0] for r in rows(s, "SELECT said FROM quay.words ORDER BY no")] == said


def test_full_text(s, asked):
    s.script("""CREATE TABLE quay.log (no INTEGER PRIMARY KEY, head TEXT, body TEXT); INSERT INTO quay.log VALUES (1, 'Mooring', 'lines were doubled in the gale'), (2, 'Gale warning', 'moored ships stay'), (3, 'Cargo', 'grain and lines of timber');
        CREATE VIRTUAL TABLE quay.seek USING fts5(head, body, content = 'log', content_rowid = 'no', tokenize = 'porter')""")
    find = lambda q, where="seek", order="bm25(seek)": [r[0] for r in rows(s, f"SELECT rowid FROM quay.seek WHERE {where} MATCH '{q}' ORDER BY {order}")]
    assert find("gale") == []  # until it is built
    s.sql("INSERT INTO quay.seek(seek) VALUES('rebuild')")
    assert sorted(find("gale")) == [1, 2] and sorted(find("moor")) == [1, 2] and find("line timber") == [3] and sorted(find("grain OR ships")) == [2, 3]
    assert find("gale", "head") == [2] and find("gale NOT warning", order="rowid") == [1] and find('"in the gale"') == [1]
    assert all("MATCH ?" in q for q, _ in asked)  # the store searches; only what it finds is read
    assert s.relations("quay") == ["log", "seek", "visits"]  # its own tables behind are hidden
    assert rows(s, "SELECT l.head FROM quay.seek k JOIN quay.log l ON l.no = k.rowid WHERE k.body MATCH 'grain'") == [("Cargo",)]
    with pytest.raises(EngineError):
        s.sql("SELECT rowid FROM quay.seek WHERE seek MATCH '\"open'").collect()
    for refused in ("SELECT * FROM port.ships WHERE name MATCH 'x'", "CREATE VIRTUAL TABLE quay.r USING rtree(a, b)", "CREATE VIRTUAL TABLE port.r USING fts5(a)"):
        with pytest.raises(Unsupported):
            s.sql(refused)


def test_near_vectors(s):
    s.script("CREATE VIRTUAL TABLE quay.spots USING vec0(at float[2]); CREATE VIRTUAL TABLE quay.ways USING vec0(at float[2] distance_metric=cosine); SET SPACE quay; BEGIN; INSERT INTO spots(rowid, at) VALUES (1, '[0, 0]'), (2, '[3, 4]'), (3, '[6, 8]'), (4, '[-1, 0]')")
    assert rows(s, "SELECT rowid, distance FROM spots WHERE at MATCH '[3, 4]' AND k = 3 ORDER BY distance") == [(2, 0.0), (1, 5.0), (3, 5.0)]
    s.sql("ROLLBACK")
    assert rows(s, "SELECT count(*) FROM spots") == [(0,)]
    s.sql("INSERT INTO quay.ways(rowid, at) VALUES (1, '[9, 0]'), (2, '[1, 1]'), (3, '[0, 5]'), (4, '[0, 0]')")
    assert [(r[0], round(r[1], 4)) for r in rows(s, "SELECT rowid, distance FROM quay.ways WHERE at MATCH '[2, 0]' AND k = 2 ORDER BY distance")] == [(1, 0.0), (2, 0.2929)]
