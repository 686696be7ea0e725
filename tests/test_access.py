"""Views, grants, policies, tokens and signed requests."""

from __future__ import annotations

import pytest
from stratafold import capability
from stratafold.errors import AccessDenied, AlreadyExists, InvalidStatement, NotFound, Unsupported
from stratafold.session import open_session

from .harbour import harbour, rows


@pytest.fixture
def s(spark, tmp_path):
    return harbour(open_session(spark, str(tmp_path / "root")))


def test_views(s):
    s.sql("CREATE VIEW port.afloat AS SELECT imo, name, tons FROM port.ships WHERE NOT scrapped")
    s.sql("SET SPACE port")
    s.sql("CREATE VIEW busy AS SELECT name, count(*) AS calls FROM afloat JOIN quay.visits USING (imo) GROUP BY name")
    assert rows(s, "SELECT name FROM busy WHERE calls > 1 ORDER BY name") == [("Heron",), ("Kestrel",)]
    for bad, error in (
        ("port.broken AS SELECT depth FROM port.ships", InvalidStatement), ("port.ships AS SELECT 1 AS a", AlreadyExists), ("port.afloat AS SELECT 1 AS a", AlreadyExists), ("port.cols (a) AS SELECT 1", Unsupported),
    ):
        with pytest.raises(error):
            s.sql(f"CREATE VIEW {bad}")
    with pytest.raises(InvalidStatement):
        s.sql("CREATE OR REPLACE VIEW port.afloat AS SELECT imo FROM port.busy JOIN port.afloat USING (name)")
    with pytest.raises(AlreadyExists):
        s.sql("CREATE TABLE port.afloat (n INT)")
    s.sql("CREATE OR REPLACE VIEW port.busy AS SELECT 'none' AS name")
    assert rows(s, "SELECT * FROM busy") == [("none",)]
    s.script("DROP VIEW port.busy; DROP VIEW IF EXISTS port.busy")
    with pytest.raises(NotFound):
        s.sql("SELECT * FROM busy")


def test_views_nest_to_a_depth(s):
    s.sql("CREATE VIEW port.d0 AS SELECT imo FROM port.ships")
    for k in range(1, 16):
        s.sql(f"CREATE VIEW port.d{k} AS SELECT imo FROM port.d{k - 1}")
    assert rows(s, "SELECT count(*) FROM port.d15") == [(6,)]
    with pytest.raises(InvalidStatement):
        s.sql("CREATE VIEW port.d16 AS SELECT imo FROM port.d15")


def test_principals_read_what_is_granted(s):
    pilot, clerk = s.engine.session("pilot"), s.engine.session("clerk")
    # What is hidden looks like what isn't there.
    for name in ("port.ships", "port.boats", "sea.ships"):
        with pytest.raises(NotFound, match=f"Table not found: {name}"):
            pilot.sql(f"SELECT * FROM {name}")
    s.script("GRANT SELECT (imo, name) ON port.ships TO pilot; GRANT SELECT ON quay.visits TO pilot, clerk")
    assert s.engine.session("pilot").sql("SELECT * FROM port.ships").frame.columns == ["imo", "name"] and pilot.relations("port") == ["ships"] and clerk.relations("port") == []
    with pytest.raises(Exception, match="tons"):
        pilot.sql("SELECT tons FROM port.ships")
    s.sql("GRANT SELECT (imo, tons) ON port.ships TO pilot")  # in place of the one before
    assert rows(pilot, "SELECT sum(tons) FROM port.ships") == [(110900,)]
    with pytest.raises(Exception, match="name"):
        pilot.sql("SELECT name FROM port.ships")
    s.sql("CREATE VIEW port.big AS SELECT name FROM port.ships WHERE tons > 40000")
    s.sql("GRANT SELECT ON port.big TO clerk")
    assert rows(clerk, "SELECT name FROM port.big ORDER BY name") == [("Heron",), ("Ibis",)]  # by the owner's rights
    s.sql("REVOKE SELECT ON port.ships FROM pilot")
    with pytest.raises(NotFound):
        pilot.sql("SELECT * FROM port.ships")
    for refused in ("INSERT INTO quay.visits VALUES (9, 101, 'east', 1.0, true)", "CREATE SPACE own", "DROP VIEW port.big", "GRANT SELECT ON quay.visits TO me", "PUBLISH SPACE quay", "BEGIN", "SHOW IDENTITY"):
        with pytest.raises(AccessDenied):
            clerk.sql(refused)
    for bad, error in (
        ("GRANT SELECT ON port.boats TO pilot", NotFound), ("GRANT SELECT (imo, depth) ON port.ships TO pilot", NotFound), ("GRANT UPDATE ON port.ships TO pilot", Unsupported), ("REVOKE SELECT (imo) ON port.ships FROM pilot", Unsupported), ("GRANT SELECT ON port.ships TO pilot WITH GRANT OPTION", Unsupported),
    ):
        with pytest.raises(error):
            s.sql(bad)


def test_policies_pick_rows(s):
    east, deep, other = (s.engine.session(p) for p in ("east", "deep", "other"))
    s.script("GRANT SELECT ON quay.visits TO east, deep, other; CREATE POLICY berth ON quay.visits TO east, deep USING (berth = current_user()); CREATE POLICY long ON quay.visits FOR SELECT TO east USING (hours >= 20)")
    # Policies add up; whoever is granted and named by none sees no row.
    assert [r[0] for r in rows(east, "SELECT no FROM quay.visits ORDER BY no")] == [1, 2, 3, 6, 7]
    assert [r[0] for r in rows(deep, "SELECT no FROM quay.visits ORDER BY no")] == [2, 6] and rows(other, "SELECT no FROM quay.visits") == []
    assert len(rows(s, "SELECT no FROM quay.visits")) == 7
    s.script("DROP POLICY long ON quay.visits; DROP POLICY IF EXISTS long ON quay.visits")
    assert [r[0] for r in rows(east, "SELECT no FROM quay.visits ORDER BY no")] == [1, 3, 7]
    for bad, error in (
        ("CREATE POLICY berth ON quay.visits TO east USING (true)", AlreadyExists), ("CREATE POLICY x ON quay.visits TO east USING (depth = 1)", InvalidStatement), ("CREATE POLICY x ON quay.visits FOR INSERT TO east USING (true)", Unsupported),
        ("CREATE POLICY x ON quay.visits AS RESTRICTIVE TO east USING (true)", Unsupported), ("DROP POLICY x ON quay.visits", NotFound),
    ):
        with pytest.raises(error):
            s.sql(bad)


def test_guards_reach_the_scan(s):
    s.script("GRANT SELECT ON port.ships TO pilot; CREATE POLICY flag ON port.ships TO pilot USING (flag = 'GR')")
    plan = s.engine.session("pilot").explain("SELECT name FROM port.ships WHERE tons > 1000")
    assert "EqualTo(flag,GR)" in plan and "GreaterThan(tons,1000)" in plan


def test_requests_pass_once():
    owner, caller = (capability.Identity(k * 32) for k in (b"o", b"c"))
    keys = {i.did: i.key for i in (owner, caller)}
    token = capability.issue(owner, caller.did, [("space/query", "port")], 3600, now=5000)
    gate, ask = capability.Gate(most=2), lambda body=b"q", at=5000: capability.sign_request(caller, "query", body, token, at)
    first = ask()
    assert gate.check("query", b"q", first, keys, now=5010)["first"] == caller.did
    for method, body, fields, now in (("query", b"q", first, 5011), ("list", b"q", ask(), 5011), ("query", b"other", ask(), 5011), ("query", b"q", ask(), 5100), ("query", b"q", ask() | {"did": owner.did}, 5011), ("query", b"q", {}, 5011), ("query", b"q", ask() | {"at": "nan"}, 5011)):
        with pytest.raises(AccessDenied):
            gate.check(method, body, fields, keys, now=now)
    with pytest.raises(AccessDenied):
        gate.check("query", b"q", ask(), keys, {capability.token_id(token)}, now=5010)
    for k in range(4):
        gate.check("query", b"q", ask(at=5200 + k), keys, now=5200 + k)
    assert len(gate.seen) == 4  # more than `most`, as all of them could still be sent again
    gate.check("query", b"q", ask(at=5400), keys, now=5400)
    assert len(gate.seen) == 2
