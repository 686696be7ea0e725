"""Tables: what is written, pinned, changed, merged, renamed and registered; and writers that race."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import types as T
from stratafold.errors import AlreadyExists, CommitConflict, ConformError, EngineError, NotFound, Unsupported
from stratafold.fs import FileSystem
from stratafold.session import open_session
from stratafold.sources.snapshots import Table

from .harbour import rows


@pytest.fixture
def s(spark, tmp_path):
    return open_session(spark, str(tmp_path / "root"))


def test_rows_take_the_tables_shape(s):
    s.script("CREATE SPACE cold; CREATE TABLE cold.readings (station BIGINT NOT NULL, label VARCHAR, taken DATE, degrees DECIMAL(9,1))")
    assert rows(s, "SELECT * FROM cold.readings") == []
    assert s.sql("INSERT INTO cold.readings (Degrees, STATION) VALUES ('-3.24', '12'), (NULL, '13'), ('warm', '14')").rows_affected == 3
    assert s.sql("INSERT INTO cold.readings SELECT 15, 'buoy', DATE '2023-02-03', 4").rows_affected == 1
    assert s.sql("INSERT INTO cold.readings SELECT 1, 'x', NULL, 4 WHERE false").rows_affected == 0
    assert [(r[0], r[1], None if r[3] is None else float(r[3])) for r in rows(s, "SELECT * FROM cold.readings ORDER BY station")] == [(12, None, -3.2), (13, None, None), (14, None, None), (15, "buoy", 4.0)]
    for bad in ("VALUES (1)", "(label) VALUES ('x')", "(station, depth) VALUES (1, 2)", "(station, station) VALUES (1, 2)"):
        with pytest.raises(ConformError):
            s.sql(f"INSERT INTO cold.readings {bad}")
    with pytest.raises(Exception, match="required column"):
        s.sql("INSERT INTO cold.readings (station) VALUES (NULL)")
    for refused in ("UPDATE cold.readings SET label = 'z'", "DELETE FROM cold.readings", "ALTER TABLE cold.readings DROP COLUMN label", "CREATE TABLE cold.copy AS SELECT 1 AS a", "CREATE TABLE cold.deep (a STRUCT(b INT))", "MERGE INTO cold.readings r USING (SELECT 1 AS k) o ON r.station = o.k WHEN MATCHED THEN DELETE"):
        with pytest.raises(Unsupported):
            s.sql(refused)
    s.script("CREATE TABLE IF NOT EXISTS cold.readings (other INT); DROP TABLE cold.readings; DROP TABLE IF EXISTS cold.readings")
    with pytest.raises(NotFound):
        s.sql("SELECT * FROM cold.readings")


def test_every_commit_can_be_read_again(s):
    s.script("CREATE SPACE cold; CREATE TABLE cold.counts (n INT)")
    table, parts = s._log("cold", "counts"), [range(4), range(10, 13), range(20, 22)]
    with pytest.raises(EngineError):
        s.compact("cold.counts")
    for p in parts:
        s.load("cold.counts", s.spark.createDataFrame([(i,) for i in p], "n int"))
    want = sorted(i for p in parts for i in p)
    old = s.sql("SELECT n FROM cold.counts").frame
    s.compact("cold.counts")
    assert len(table.files(table.snapshot())) == 1 and sorted(r.n for r in old.collect()) == sorted(r.n for r in s.table("cold.counts").collect()) == want
    assert [sorted(r.n for r in s.table("cold.counts", version=v).collect()) for v in (1, 2, 3, 4)] == [sorted(i for p in parts[:k] for i in p) for k in range(4)]
    assert [x.operation for x in table.history()] == ["create", "append", "append", "append", "compact"]
    stale = table.snapshot()
    s.sql("INSERT INTO cold.counts VALUES (99)")
    with pytest.raises(CommitConflict):
        table._swap(stale, None, "delete")


def test_rows_change_by_version(s):
    s.script("CREATE SPACE lab WITH FORMAT = 'lance'; CREATE TABLE lab.samples AS SELECT id, id % 7 AS tray, 'fresh' AS state FROM range(60)")
    assert s.sql("UPDATE lab.samples SET state = concat(state, '/', tray), tray = tray + 100 WHERE tray = 3").rows_affected == 9
    assert s.sql("DELETE FROM lab.samples WHERE id BETWEEN 50 AND 54").rows_affected == 5 and s.sql("DELETE FROM lab.samples WHERE id > 1000").rows_affected == 0
    assert rows(s, "SELECT count(*), sum(tray), count(DISTINCT state) FROM lab.samples") == [(55, sum((i % 7) + (100 if i % 7 == 3 else 0) for i in range(60) if not 50 <= i <= 54), 2)]
    s.script("ALTER TABLE lab.samples ADD COLUMN grams DOUBLE; ALTER TABLE lab.samples RENAME COLUMN state TO note; ALTER TABLE lab.samples ALTER COLUMN tray TYPE VARCHAR; ALTER TABLE lab.samples DROP COLUMN id")
    assert [(f.name, f.dataType) for f in s.table("lab.samples").schema.fields] == [("tray", T.StringType()), ("note", T.StringType()), ("grams", T.DoubleType())]


def test_merge_rewrites_the_files_it_meets(s):
    s.script("CREATE SPACE lab WITH FORMAT = 'lance'; CREATE TABLE lab.bins (k BIGINT, _row BIGINT, there VARCHAR)")
    table = s._log("lab", "bins")
    for first in (0, 100, 200):
        s.sql(f"INSERT INTO lab.bins SELECT id + {first}, id, 'old' FROM range(5)")
    before = set(table.files(table.snapshot()))
    n = s.sql("""MERGE INTO lab.bins t USING (SELECT 101 AS k, 'a' AS there UNION ALL SELECT 102, 'b' UNION ALL SELECT 900, 'c' UNION ALL SELECT 901, 'd') s ON t.k = s.k
        WHEN MATCHED AND s.there = 'a' THEN DELETE WHEN MATCHED THEN UPDATE SET there = s.there, _row = t._row + 50 WHEN NOT MATCHED AND s.k < 901 THEN INSERT (k, there) VALUES (s.k, s.there)""").rows_affected
    assert n == 3
    assert set(rows(s, "SELECT * FROM lab.bins WHERE there <> 'old' OR k BETWEEN 100 AND 102")) == {(100, 0, "old"), (102, 52, "b"), (900, None, "c")}
    assert len(before & set(table.files(table.snapshot()))) == len(before) - len({f for f in before if f not in table.files(table.snapshot())}) >= 2
    assert s.sql("MERGE INTO lab.bins t USING (SELECT 200 AS k UNION ALL SELECT 200) s ON t.k = s.k WHEN MATCHED AND false THEN DELETE").rows_affected == 0
    with pytest.raises(EngineError, match="several source rows"):
        s.sql("MERGE INTO lab.bins t USING (SELECT 200 AS k UNION ALL SELECT 200) s ON t.k = s.k WHEN MATCHED THEN DELETE")
    assert s.sql("MERGE INTO lab.bins t USING (SELECT 3 AS k) s ON t.k = s.k WHEN NOT MATCHED BY SOURCE THEN DELETE").rows_affected == 14
    assert rows(s, "SELECT k FROM lab.bins") == [(3,)]


def test_tables_are_renamed_and_registered(s, tmp_path):
    s.spark.range(8).write.parquet(str(tmp_path / "made.parquet"))
    s.script("CREATE SPACE cold; CREATE TABLE cold.old (n INT); INSERT INTO cold.old VALUES (4); GRANT SELECT ON cold.old TO kim; CREATE POLICY p ON cold.old TO kim USING (n > 3)")
    s.sql("ALTER TABLE cold.old RENAME TO fresh")
    assert rows(s.engine.session("kim"), "SELECT n FROM cold.fresh") == [(4,)] and s.relations("cold") == ["fresh"]
    with pytest.raises(NotFound):
        s.sql("SELECT * FROM cold.old")
    s.register("cold.made", str(tmp_path / "made.parquet"))
    s.load("cold.made", s.spark.range(100, 102))
    assert rows(s, "SELECT count(*), max(id) FROM cold.made") == [(10, 101)] and len(rows(s, "SELECT * FROM cold.made WHERE id < 8")) == 8
    with pytest.raises(AlreadyExists):
        s.register("cold.fresh", str(tmp_path / "made.parquet"))
    with pytest.raises(AlreadyExists):
        s.sql("ALTER TABLE cold.made RENAME TO fresh")


@pytest.mark.parametrize("local", [True, False])
def test_of_many_writers_one_succeeds(spark, tmp_path, monkeypatch, local):
    fs = FileSystem(spark)
    if not local:  # the way of other file systems, here with one writer at a time

        def write(path: str, text: str, overwrite: bool = False) -> bool:
            aside = f"{path}.aside"
            assert fs._jvm is not None
            FileSystem.write(fs, aside, text, overwrite=True)
            system, p = fs._at(path)
            return fs._put(fs._jvm.org.apache.hadoop.fs.Path(aside), p, overwrite)

        assert [write(str(tmp_path / "x"), t) for t in "ab"] == [True, False] and fs.read(str(tmp_path / "x")) == "a"
        assert write(str(tmp_path / "x"), "c", overwrite=True) and fs.read(str(tmp_path / "x")) == "c" and [n for n, _ in fs.list(str(tmp_path))] == ["x"]
        return
    with ThreadPoolExecutor(8) as pool:
        for r in range(100):
            path = str(tmp_path / "log" / f"{r:03d}.json")
            won = list(pool.map(lambda k, path=path: fs.write(path, f"writer {k}"), range(8)))
            assert sum(won) == 1 and fs.read(path) == f"writer {won.index(True)}"
    assert len(fs.list(str(tmp_path / "log"))) == 100
    assert fs.write(path, "over", overwrite=True) and fs.read(path) == "over"


def test_a_batch_that_runs_twice_at_once_lands_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t")).create(T.StructType([T.StructField("id", T.LongType())]))
    with ThreadPoolExecutor(4) as pool:
        for batch in range(3):
            list(pool.map(lambda _, b=batch: Table(spark, str(tmp_path / "t")).append_batch(spark.range(5), "feed", b), range(4)))
    assert table.frame().count() == 15 and table.snapshot().streams == {"feed": 2} and len(table.versions()) == 4
    folders = {f["file"].split("/")[0] for f in table.entries(table.snapshot())}
    assert {n for n, _ in table.fs.list(f"{table.path}/data")} == folders
