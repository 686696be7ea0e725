from __future__ import annotations

import hashlib

import pytest
from stratafold.llm import warc

HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: %s\r\n\r\n"
#: Heads with lengths that are none, that reach far beyond the page, and of other versions.
HOSTILE = "".join(HEAD % n for n in ("\u00b2", "9" * 5000, "-1", "1_0", " 7 ", "", "\u0663", 10**18 - 1, 10**17, 0)) + "WARC/1.0\r\nx\r\n\r\nWARC/1.7\r\nWARC/1."
NESTED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_round_trip(spark, tmp_path):
    long = "<p>x</p>" * 200
    pages = [(1, "http://a/1", long), (2, None, long), (3, "http://a/ b\r\nc", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", NESTED * 40), (8, "u", "WARC/1.1\r\n" * 300), (9, "u", "é日" * 400), (9, "u", "é日" * 400), (10, "u", "y" * 3_000_000), (11, "u", HOSTILE), (12, "u", HOSTILE * 30 + "z" * 2000), (13, "u", HOSTILE * 30 + "z" * 2000), (14, "u", "\r\n\r\n" + HOSTILE)]
    spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, type string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).collect()), key=str)
    first = {}
    for i, _, h in pages:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            first[h] = max(i, first.get(h, i))
    want = []
    for i, _, h in pages:
        h = (h or "").encode()
        again = len(h) >= 1000 and sum((x or "").encode() == h for _, _, x in pages) > 1 and i != first[h]
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)


def test_small_windows_and_broken_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", NESTED * (i % 4) + "z" * (i * 7)) for i in range(120)], "page_id bigint, url string, html string").coalesce(1)
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path)
    import glob
    import gzip
    import os

    (file,) = glob.glob(path + "/part-*")
    data = gzip.open(file).read()
    os.mkdir(tmp_path / "again")
    with gzip.open(tmp_path / "again" / "a.warc.gz", "wb") as f:
        f.write(data)
    want = sorted((f"<urn:page:{i}>", len(h), hashlib.sha1(h.encode()).hexdigest()) for i in range(120) for h in [NESTED * (i % 4) + "z" * (i * 7)])
    for window, at_once in ((warc.WINDOW, 1 << 20), (700, 40), (64, 1 << 20)):
        assert sorted((r.id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "again"), window, at_once).collect()) == want
    at = data.index(b"<urn:page:60>")
    with gzip.open(tmp_path / "again" / "a.warc.gz", "wb") as f:  # cut short within a record
        f.write(data[: at + 200])
    got = [r.id for r in warc.read_archives(spark, str(tmp_path / "again"), 700).collect()]
    assert sorted(got) == sorted(f"<urn:page:{i}>" for i in range(60))
    with gzip.open(tmp_path / "again" / "a.warc.gz", "wb") as f:
        f.write(b"junk" + data)
    assert warc.read_archives(spark, str(tmp_path / "again")).collect() == []


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(version: str, kind: str, id_: str, block: bytes, *lines: str) -> bytes:
        return "\r\n".join([f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"body WARC/1.0\r\nnot a head"
    parts = [record("1.0", "warcinfo", "a", b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields"), record("1.0", "response", "b", page, "Content-Type: application/http; msgtype=response"), record("1.1", "resource", "c", b"plain", "Content-Type: text/plain")]
    with open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, parts)))  # a member for each record
    got = {r.id: (r.type, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    bodies = {"a": b"software: x\r\n\r\nmore", "b": b"body WARC/1.0\r\nnot a head", "c": b"plain"}
    assert {k: v[1:] for k, v in got.items()} == {k: (len(b), hashlib.sha1(b).hexdigest()) for k, b in bodies.items()} and got["a"][0] == "warcinfo"
    (tmp_path / "y.warc").write_bytes(b"".join(parts))
    with pytest.raises(ValueError, match="not gzip"):
        warc.read_archives(spark, str(tmp_path / "y.warc"))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path)).collect() == []
