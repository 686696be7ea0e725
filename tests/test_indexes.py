"""Searches with an index give what scans give, and read less."""

from __future__ import annotations

import random

import pytest
from stratafold.errors import AlreadyExists, InvalidStatement, NotFound, Unsupported
from stratafold.operators import indexes
from stratafold.session import open_session

from .harbour import rows


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    s = open_session(spark, str(tmp_path_factory.mktemp("indexed")))
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    data = []
    for i in range(600):
        x, y = rng.choice([(0, 0), (50, 0), (0, 50), (70, 70)])
        data.append((i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(0, 30))) if i % 11 else None, [x + rng.gauss(0, 2), y + rng.gauss(0, 2)] if i % 13 else [1.0] if i % 2 else None))
    data += [(1000 + i, "w1 w2", [50.0, 1.0]) for i in range(20)]  # ties
    s.script("CREATE SPACE lab WITH FORMAT = 'lance'; CREATE TABLE lab.notes (id BIGINT, body VARCHAR, at FLOAT[2])")
    s.load("lab.notes", spark.createDataFrame(data, "id bigint, body string, at array<float>").repartition(3))
    return s


SEARCHES = [f"SELECT id, _score FROM lance_fts(lab.notes, 'body', '{q}', k => {k})" for q, k in (("w0 w5", 20), ("w1", 7), ("w39 OR missing", 5), ("missing", 5))] + [
    f"SELECT id, {d} FROM lance_vector_search(lab.notes, 'at', [{q}], k => {k}{m})" for q, k, m, d in (("50, 1", 10, "", "_distance"), ("35, 35", 30, "", "_distance"), ("70, 71", 700, "", "_distance"), ("1", 3, "", "_distance"), ("3, 70", 12, ", metric => 'cosine'", "_distance"), ("1, 2, 3", 3, "", "_distance"))
]


def test_searches_agree_with_scans(s):
    plain = [rows(s, q) for q in SEARCHES]
    s.script("CREATE INDEX by_word ON lab.notes USING INVERTED (body); CREATE INDEX near ON lab.notes USING IVF_FLAT (at) WITH (metric_type = 'l2'); CREATE INDEX angle ON lab.notes USING IVF_PQ (at) WITH (metric_type = 'cosine')")
    calls, found = [], indexes.current
    try:
        indexes.current = lambda *a: calls.append(got := found(*a)) or got
        for q, want in zip(SEARCHES, plain, strict=True):
            assert rows(s, q) == want, q
    finally:
        indexes.current = found
    assert len(calls) == len(SEARCHES) and all(calls)
    # A change makes them stale: searches scan, and see it.
    s.sql("INSERT INTO lab.notes VALUES (5000, 'missing', [70, 71])")
    assert rows(s, "SELECT id FROM lance_fts(lab.notes, 'body', 'missing', k => 5)") == [(5000,)] and (5000,) in rows(s, "SELECT id FROM lance_vector_search(lab.notes, 'at', [70, 71], k => 1)")
    s.sql("DELETE FROM lab.notes WHERE id = 5000")


def test_few_cells_are_read(s, monkeypatch):
    s.sql("CREATE INDEX cells ON lab.notes USING IVF_SQ (at)")
    table = s._log("lab", "notes")
    folder, meta = indexes.current(table, ["cells"], indexes.VECTOR, "at", table.snapshot(), "l2")
    read, scored = [], indexes._scored
    monkeypatch.setattr(indexes, "_scored", lambda cells, *a: read.append(cells.select("cell").distinct().count()) or scored(cells, *a))
    assert indexes.vector_search(table, table.snapshot(), folder, meta, [50.0, 1.0], 3, "l2").count() == 3
    assert len(meta["centres"]) > 20 and max(read) < len(meta["centres"]) / 2


def test_rules(s):
    s.sql("CREATE INDEX plain ON lab.notes USING BTREE (id)")
    with pytest.raises(AlreadyExists):
        s.sql("CREATE INDEX plain ON lab.notes USING BITMAP (id)")
    for bad in ("CREATE INDEX x ON lab.notes USING RTREE (at)", "CREATE INDEX x ON lab.notes USING BTREE (id, body)", "CREATE INDEX IF NOT EXISTS x ON lab.notes USING BTREE (id)", "DROP INDEX IF EXISTS plain ON lab.notes"):
        with pytest.raises(Unsupported):
            s.sql(bad)
    with pytest.raises(NotFound):
        s.sql("CREATE INDEX x ON lab.notes USING BTREE (depth)")
    with pytest.raises(InvalidStatement):
        s.sql("CREATE INDEX x ON lab.notes USING IVF_FLAT (at) WITH (metric_type = 'taxi')")
    s.sql("DROP INDEX plain ON lab.notes")
    with pytest.raises(NotFound):
        s.sql("DROP INDEX plain ON lab.notes")
    s.script("CREATE SPACE cold; CREATE TABLE cold.t (n INT, body VARCHAR)")
    for refused in ("CREATE INDEX x ON cold.t USING BTREE (n)", "SELECT * FROM lance_fts(cold.t, 'body', 'x')", "SELECT * FROM lance_fts(lab.notes, 'body', 'w1') f JOIN cold.t ON f.id = t.n"):
        with pytest.raises(Unsupported):
            s.sql(refused)
    with pytest.raises(InvalidStatement):
        s.sql("SELECT * FROM lance_fts('lab.notes', 'body', 'x')")
