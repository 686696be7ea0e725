"""Names, parameters, spaces and the rows that queries over several of them give."""

from __future__ import annotations

import pyarrow as pa
import pytest
from stratafold.errors import AlreadyExists, EngineError, InvalidProperty, InvalidStatement, NotFound, Unsupported
from stratafold.session import Engine, open_session

from .harbour import SHIPS, VISITS, harbour, rows


@pytest.fixture
def s(spark, tmp_path):
    return open_session(spark, str(tmp_path / "root"))


def test_queries_across_spaces(s):
    harbour(s)
    hours = {}
    for _, imo, _, h, _ in VISITS:
        for ship in SHIPS:
            if ship[0] == imo:
                hours[ship[1]] = hours.get(ship[1], 0.0) + h
    assert dict(rows(s, "SELECT flag, sum(hours) FROM port.ships JOIN quay.visits USING (imo) GROUP BY flag")) == hours
    absent = {imo for imo, *_ in SHIPS} - {v[1] for v in VISITS}
    assert {r[0] for r in rows(s, "SELECT imo FROM port.ships WHERE imo NOT IN (SELECT imo FROM quay.visits)")} == absent
    assert rows(s, "SELECT v.no FROM quay.visits v LEFT ANTI JOIN port.ships h ON v.imo = h.imo") == [(7,)]
    assert rows(s, "SELECT ships.name, quay.visits.berth FROM port.ships, quay.visits WHERE port.ships.imo = quay.visits.imo AND hours BETWEEN 5 AND 10") == [("Rail", "west")]
    assert rows(s, "SELECT count(*) FROM quay.visits a JOIN quay.visits b ON a.berth = b.berth AND a.no < b.no") == [(5,)]
    assert rows(s, "SELECT max(tons) FROM port.ships WHERE tons < ? AND flag = ?", [50000, "GR"]) == [(43000,)]
    assert rows(s, "WITH late AS (SELECT imo FROM quay.visits WHERE NOT paid), all_of AS (SELECT imo FROM late UNION SELECT imo FROM port.ships WHERE scrapped) FROM all_of ORDER BY imo") == [(103,), (104,), (999,)]


def test_names_need_a_space(s):
    harbour(s)
    for bad in ("SELECT * FROM ships", "SELECT * FROM a.port.ships", "SELECT 1; SELECT 2", ""):
        with pytest.raises(InvalidStatement):
            s.sql(bad)
    for missing in ("SET SPACE nowhere", "SELECT * FROM port.boats", "SELECT * FROM quay.boats", "DROP TABLE port.boats"):
        with pytest.raises(NotFound):
            s.sql(missing)
    for unknown in ("SHOW TABLES", "CREATE SCHEMA x", "EXPLAIN DROP TABLE port.ships", "VACUUM"):
        with pytest.raises(Unsupported):
            s.sql(unknown)
    s.sql("SET SPACE port")
    assert rows(s, "SELECT count(*) FROM ships") == [(6,)] and s.relations("port") == ["ships"] and s.relations("quay") == ["visits"]
    assert rows(s, "SELECT '{' || name || ';}' FROM ships WHERE imo = 105") == [("{Rail;}",)]
    assert "PushedFilters: [IsNotNull(tons), GreaterThan(tons,4000)]" in s.explain("SELECT name FROM ships WHERE tons > 4000")


def test_spaces_and_locations(s):
    for bad in ("STORAGE = 'punched cards'", "LOCATION = 'lost'", "TIDE = 'high'", "KIND = 'magic'", "KIND = 'transactional', ACCESS = 'ro'", "KIND = 'transactional', FORMAT = 'parquet'", "KIND = 'remote'", "ENGINE = 'row'", ""):
        with pytest.raises(EngineError):
            s.sql(f"CREATE SPACE wet WITH {bad}")
    s.script("CREATE SPACE wet; CREATE SPACE dry WITH KIND = 'transactional'")
    with pytest.raises(AlreadyExists):
        s.sql("CREATE SPACE wet")
    # One writer a location; others read it, and a row store is never written by an analytical space.
    s.script("CREATE SPACE mirror WITH LOCATION = 'wet'; CREATE SPACE glass WITH LOCATION = 'dry'")
    assert [s.registry.spaces[n].access for n in ("mirror", "glass")] == ["readonly", "readonly"]
    for bad in ("LOCATION = 'wet', ACCESS = 'rw'", "LOCATION = 'dry', ACCESS = 'writable'", "KIND = 'transactional', LOCATION = 'wet'"):
        with pytest.raises(InvalidProperty):
            s.sql(f"CREATE SPACE third WITH {bad}")
    # A dropped space leaves its location behind, for whoever binds it next.
    s.sql("DROP SPACE wet")
    with pytest.raises(InvalidProperty):
        s.sql("CREATE SPACE wet")
    s.sql("CREATE SPACE damp WITH LOCATION = 'wet', ACCESS = 'rw'")
    assert set(Engine(s.spark, s.engine.root).session().registry.spaces) == {"damp", "dry", "mirror", "glass"}


def test_tables_of_this_process(s):
    harbour(s)
    s.engine.attach_memory("held", {"flags": pa.table({"flag": ["NO", "GR"], "country": ["Norway", "Greece"]}), "more": s.spark.range(3)})
    assert rows(s, "SELECT country, count(*) FROM held.flags JOIN port.ships USING (flag) GROUP BY country ORDER BY country") == [("Greece", 2), ("Norway", 2)]
    assert s.relations("held") == ["flags", "more"] and rows(s, "SELECT sum(id) FROM held.more") == [(3,)]
    s.sql("CREATE SPACE after")  # written down without the held space
    assert "held" not in Engine(s.spark, s.engine.root).session().registry.spaces and "held" in s.registry.spaces
    with pytest.raises(NotFound):
        s.sql("SELECT * FROM held.other")
    s.sql("DROP SPACE held")
    with pytest.raises(NotFound):
        s.sql("SELECT * FROM held.flags")
