"""Ships in an analytical space and their visits in a row store, for tests."""

from __future__ import annotations

SHIPS = [(101, "NO", "Kestrel", 5200, False), (102, "NO", "Tern", 800, False), (103, "GR", "Ibis", 43000, True), (104, "PA", "Heron", 61000, False), (105, "GR", "Rail", 900, False), (106, "LR", "Crake", None, False)]
VISITS = [(1, 101, "east", 12.5, True), (2, 104, "deep", 40.0, False), (3, 101, "east", 3.0, True), (4, 105, "west", 7.25, None), (5, 102, "west", 1.5, True), (6, 104, "deep", 22.0, True), (7, 999, "east", 9.0, False)]


def literal(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else str(value)


def values(rows) -> str:
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def harbour(s):
    s.script(f"""CREATE SPACE port; CREATE TABLE port.ships (imo BIGINT NOT NULL, flag VARCHAR NOT NULL, name VARCHAR, tons INT, scrapped BOOLEAN); INSERT INTO port.ships VALUES {values(SHIPS)};
        CREATE SPACE quay WITH KIND = 'transactional'; CREATE TABLE quay.visits (no INTEGER PRIMARY KEY, imo INTEGER, berth TEXT NOT NULL, hours REAL, paid BOOLEAN); INSERT INTO quay.visits VALUES {values(VISITS)}""")
    return s


def rows(session, sql, args=None):
    return [tuple(r) for r in session.sql(sql, args).collect()]
