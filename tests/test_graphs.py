"""Property graphs: definitions, patterns and shortest paths."""

from __future__ import annotations

import pytest
from stratafold.errors import AccessDenied, AlreadyExists, InvalidStatement, NotFound, Unsupported
from stratafold.session import Engine, open_session

from .harbour import harbour, rows

LANES = "CREATE PROPERTY GRAPH net.lanes VERTEX TABLES (harbours LABEL harbour) EDGE TABLES (routes SOURCE KEY (out_of) REFERENCES harbours (code) DESTINATION KEY (bound_for) REFERENCES harbours (code) LABEL route)"
#: A ring of five, a spur, and a pair apart.
ROUTES = [("AAR", "BGO", 2), ("BGO", "CUX", 1), ("CUX", "DOV", 3), ("DOV", "ESB", 1), ("ESB", "AAR", 2), ("BGO", "DOV", 9), ("DOV", "FAO", 5), ("GDN", "HEL", 1)]
CODES = sorted({c for a, b, _ in ROUTES for c in (a, b)})


def shortest(sources: list[str], edges: set[tuple[str, str]], zero: bool = False) -> set[tuple[str, str, int]]:
    out = set()
    for s in sources:
        seen, front, n = ({s: 0} if zero else {}), {s}, 0
        while front:
            n += 1
            front = {b for a, b in edges if a in front} - seen.keys()
            seen |= dict.fromkeys(front, n)
        out |= {(s, t, n) for t, n in seen.items()}
    return out


@pytest.fixture
def s(spark, tmp_path):
    s = open_session(spark, str(tmp_path / "root"))
    s.script(f"""CREATE SPACE net WITH FORMAT = 'versioned'; CREATE TABLE net.harbours (code VARCHAR, north BOOLEAN); INSERT INTO net.harbours VALUES {', '.join(f"('{c}', {c < 'E'})" for c in CODES)};
        CREATE TABLE net.routes (out_of VARCHAR, bound_for VARCHAR, days INT); INSERT INTO net.routes VALUES {', '.join(map(str, ROUTES))}; {LANES}""")
    return s


def test_patterns(s):
    edges = {(a, b) for a, b, _ in ROUTES}
    assert set(rows(s, "FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)-[r:route]->(b:harbour) COLUMNS (a.code AS a, b.code AS b, r.days))")) == set(ROUTES)
    assert set(rows(s, "FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)<-[r:route]-(b:harbour WHERE NOT b.north) COLUMNS (a.code AS a, b.code AS b))")) == {(b, a) for a, b in edges if a >= "E"}
    assert set(rows(s, "FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)-[q:route]->(m:harbour)-[r:route WHERE r.days < 3]->(b:harbour) COLUMNS (a.code AS a, m.code AS m, b.code AS b))")) == {(a, m, b) for a, m in edges for x, b, d in ROUTES if x == m and d < 3}
    assert set(rows(s, "FROM GRAPH_TABLE (net.lanes MATCH (a:harbour WHERE a.code > 'F') COLUMNS (a.code AS code))")) == {("FAO",), ("GDN",), ("HEL",)}
    assert rows(s, "SELECT g.code, count(*) FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)-[r:route]->(b:harbour) COLUMNS (a.code AS code)) g JOIN net.harbours h ON h.code = g.code AND h.north GROUP BY g.code HAVING count(*) > 1 ORDER BY 1") == [("BGO", 2), ("DOV", 2)]
    s.sql("DELETE FROM net.routes WHERE days > 4")
    assert len(rows(Engine(s.spark, s.engine.root).session(), "FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)-[r:route]->(b:harbour) COLUMNS (a.code AS code))")) == 6


@pytest.mark.parametrize(("mark", "zero"), [("+", False), ("*", True)])
def test_shortest_paths(s, mark, zero):
    find = f"FROM GRAPH_TABLE (net.lanes MATCH p = ANY SHORTEST (a:harbour%s)-[r:route%s]->{mark}(b:harbour) COLUMNS (a.code AS a, b.code AS b, path_length(p) AS n))"
    edges = {(a, b) for a, b, _ in ROUTES}
    assert set(rows(s, find % ("", ""))) == shortest(CODES, edges, zero)
    assert set(rows(s, find % (" WHERE a.code = 'AAR'", " WHERE r.days < 4"))) == shortest(["AAR"], {(a, b) for a, b, d in ROUTES if d < 4}, zero)
    assert (("AAR", "AAR", 0) if zero else ("AAR", "AAR", 4)) in rows(s, find % ("", ""))


def test_rules(s):
    for bad, error in (
        (LANES, AlreadyExists), ("CREATE PROPERTY GRAPH net.g VERTEX TABLES (port.ships)", Unsupported), ("CREATE PROPERTY GRAPH net.g VERTEX TABLES (rivers)", NotFound), (LANES.replace("net.lanes", "net.g").replace("(out_of)", "(nowhere)"), NotFound),
        ("FROM GRAPH_TABLE (net.lanes MATCH (a:river) COLUMNS (a.code))", NotFound), ("FROM GRAPH_TABLE (net.lakes MATCH (a:harbour) COLUMNS (a.code))", NotFound), ("FROM GRAPH_TABLE (net.lanes MATCH (a:harbour)-[r:route]->+(b:harbour) COLUMNS (a.code))", InvalidStatement),
    ):
        with pytest.raises(error):
            s.sql(bad)
    harbour(s)
    for refused in ("CREATE PROPERTY GRAPH port.g VERTEX TABLES (ships)", "SELECT * FROM GRAPH_TABLE (net.lanes MATCH (a:harbour) COLUMNS (a.code)) g JOIN port.ships p ON p.name = g.code"):
        with pytest.raises(Unsupported):
            s.sql(refused)
    with pytest.raises(AccessDenied):
        s.engine.session("guest").sql("FROM GRAPH_TABLE (net.lanes MATCH (a:harbour) COLUMNS (a.code))")
    s.script(LANES.replace("GRAPH", "GRAPH IF NOT EXISTS", 1) + "; DROP PROPERTY GRAPH net.lanes; DROP PROPERTY GRAPH IF EXISTS net.lanes")
    with pytest.raises(NotFound):
        s.sql("FROM GRAPH_TABLE (net.lanes MATCH (a:harbour) COLUMNS (a.code))")
