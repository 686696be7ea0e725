"""Publishing row stores, and spaces of other roots: mounted, copied and refreshed."""

from __future__ import annotations

import os

import pytest
from stratafold.errors import AccessDenied, EngineError, Unsupported
from stratafold.session import open_session

from .harbour import SHIPS, VISITS, harbour, rows


@pytest.fixture
def owner(spark, tmp_path):
    s = harbour(open_session(spark, str(tmp_path / "owner")))
    s.sql("CREATE TABLE quay.seals (no INTEGER, mark BLOB)")
    s.sql("INSERT INTO quay.seals VALUES (1, x'ff00'), (2, NULL)")
    return s


def test_publish(owner):
    assert [r[:2] for r in rows(owner, "PUBLISH SPACE quay")] == [("seals", 2), ("visits", 7)]
    assert sorted(rows(owner, "SELECT * FROM quay_published.visits"), key=lambda r: r[0]) == VISITS and rows(owner, "SELECT mark FROM quay_published.seals ORDER BY no") == [(bytearray(b"\xff\x00"),), (None,)]
    for refused in ("INSERT INTO quay_published.seals VALUES (3, NULL)", "CREATE TABLE quay_published.more (n INT)", "DROP TABLE quay_published.seals"):
        with pytest.raises(AccessDenied):
            owner.sql(refused)
    with pytest.raises(AccessDenied):
        owner.sql("PUBLISH SPACE quay TO port")
    with pytest.raises(Unsupported):
        owner.sql("PUBLISH SPACE port")
    with pytest.raises(EngineError):
        owner.sql("PUBLISH SPACE quay TABLES (missing)")
    # One table leaves the others; all of them drop what is gone; and a new column makes a table anew.
    owner.script("DELETE FROM quay.visits WHERE no > 2; ALTER TABLE quay.seals ADD COLUMN wax TEXT; PUBLISH SPACE quay TABLES (seals) TO show")
    assert owner.relations("show") == ["seals"] and owner.sql("SELECT * FROM show.seals").frame.columns == ["no", "mark", "wax"] and rows(owner, "SELECT count(*) FROM quay_published.visits") == [(7,)]
    owner.script("DROP TABLE quay.seals; PUBLISH SPACE quay")
    assert owner.relations("quay_published") == ["visits"] and rows(owner, "SELECT count(*) FROM quay_published.visits") == [(2,)]


@pytest.fixture
def guest(spark, tmp_path, owner):
    guest = open_session(spark, str(tmp_path / "guest"))
    did = guest.sql("SHOW IDENTITY").collect()[0].did
    owner.script(f"PUBLISH SPACE quay; GRANT SELECT ON quay_published.visits TO '{did}'; GRANT SELECT (no) ON quay_published.seals TO '{did}'")
    guest.token = owner.sql(f"ISSUE UCAN ON SPACE quay_published TO '{did}' CAN 'space/read' EXPIRES IN 90 minutes").collect()[0]
    return guest


def test_a_copy_is_refreshed(owner, guest, tmp_path):
    made = rows(guest, f"CREATE SPACE copy WITH TOKEN = '{guest.token.token}', PEER = '{owner.engine.root}', REMOTE = 'quay_published', MODE = 'replica'")
    assert [(r[0], r[4]) for r in made] == [("seals", "restricted"), ("visits", "updated")] and made[1][2] >= 1 and made[1][3] > 0
    assert sorted(rows(guest, "SELECT * FROM copy.visits"), key=lambda r: r[0]) == VISITS
    assert [r[2:] for r in rows(guest, "REFRESH SPACE copy")] == [(0, 0, "restricted"), (0, 0, "current")]
    owner.script("UPDATE quay.visits SET hours = 0 WHERE no = 1; PUBLISH SPACE quay TABLES (visits)")
    before = guest.sql("SELECT hours FROM copy.visits WHERE no = 1").frame
    assert rows(guest, "SELECT hours FROM copy.visits WHERE no = 1") == [(12.5,)]
    # A file that was damaged after it was published isn't taken.
    table = owner._log("quay_published", "visits")
    (file,) = [f for f in table.files(table.snapshot())][:1]
    good = open(file, "rb").read()
    open(file, "wb").write(good[:-1] + bytes([good[-1] ^ 1]))
    with pytest.raises(EngineError, match="damaged or gone"):
        guest.sql("REFRESH SPACE copy")
    folder, name = os.path.split(file)
    os.unlink(f"{folder}/.{name}.crc")  # which the file system had noticed; now the recorded hash must
    with pytest.raises(EngineError, match="damaged$"):
        guest.sql("REFRESH SPACE copy")
    assert rows(guest, "SELECT hours FROM copy.visits WHERE no = 1") == [(12.5,)]
    open(file, "wb").write(good)
    assert rows(guest, "REFRESH SPACE copy")[1][4] == "updated" and rows(guest, "SELECT hours FROM copy.visits WHERE no = 1") == [(0.0,)]
    assert [tuple(r) for r in before.collect()] == [(12.5,)]  # readers under way keep their snapshot
    with pytest.raises(Unsupported):
        owner.sql("REFRESH SPACE port")
    every = guest.publish_every(60, "REFRESH SPACE copy")
    every.stop()
    assert every.runs >= 1 and not every.errors
    guest.sql("DROP SPACE copy")
    assert not guest.engine.fs.exists(f"{guest.engine.root}/replica/copy")


def test_a_mounted_space_is_read_by_its_owners_rules(owner, guest):
    did = guest.sql("SHOW IDENTITY").collect()[0].did
    owner.script(f"CREATE POLICY paid ON quay_published.visits TO '{did}' USING (paid)")
    guest.sql(f"CREATE SPACE far WITH TOKEN = '{guest.token.token}', PEER = '{owner.engine.root}', REMOTE = 'quay_published'")
    guest.engine.attach_memory("mine", {"ships": guest.spark.createDataFrame(SHIPS, "imo bigint, flag string, name string, tons int, scrapped boolean")})
    assert rows(guest, "SELECT name, sum(hours) FROM far.visits JOIN mine.ships USING (imo) GROUP BY name ORDER BY name") == [("Heron", 22.0), ("Kestrel", 15.5), ("Tern", 1.5)]
    assert guest.sql("SELECT * FROM far.seals").frame.columns == ["no"] and len(rows(guest, "SHOW PEERS")) == 1
    with pytest.raises(Unsupported):
        guest.sql("ISSUE UCAN ON SPACE far TO 'x'")
    assert rows(owner, "SHOW UCANS")[0][4] is False
    assert owner.sql(f"REVOKE UCAN '{guest.token.id}'").rows_affected == 1 and owner.sql(f"REVOKE UCAN '{guest.token.id}'").rows_affected == 0
    with pytest.raises(AccessDenied):
        guest.sql("SELECT * FROM far.visits")
