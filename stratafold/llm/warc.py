"""WARC archives: writing pages, and reading archives back by verified record boundaries.

Writing.  Each page is a record whose block is an HTTP response; of pages with equal payloads of at least `least_revisit` bytes, the one
with the largest id is written whole and the others as `revisit` records that carry headers only.  Records are put
together by Spark's own expressions and written by its text writer, gzip-compressed, so that any file system Spark knows will do.

Reading.  The version line may stand inside a payload, so each place where it stands is only a candidate record.  Tasks cut the archive at
those places and emit, for each candidate, its offset and that of its successor by its Content-Length; and the digest and length of its
payload, if no other version line stands in it.  True records are those that the chain of successors reaches from the start of the file.  Chains are
shortened inside windows of the file where they are read; pointer jumping over the windows' entries then finds, in as many rounds as the logarithm of the
number of windows, which candidates the chain enters each window at; and a walk from there keeps the records of the window.  Records with version
lines in their payload are read again, once it is known that they are true: these don't overlap, so a second pass hashes each byte once at
most and holds none, whatever lengths false heads claim.

Archives are read as Spark's text files, whole, so they must be compressed in a form that Spark doesn't split; what is written is gzip,
one member a file.

Edge cases: a null html is an empty payload; a null url has no target line, and white space and control characters in a url are percent-encoded; a
null page id is written as `null`, doesn't count as largest, and is read back as null; rows that repeat an id and payload are all responses;
a truncated record ends the chain, and neither it nor what stands behind it is returned; a head whose length isn't a number of 18 ASCII digits
at most is none; columns besides those named are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_batches, new_path, scratch, stored

MAGIC = "WARC/1.1\r\n"
#: What version lines begin with; the rest of them stands at the start of a piece.
SPLIT, VERSIONS = "WARC/1.", (b"0\r\n", b"1\r\n")
LEAST_REVISIT = 1000
RECORDS_PER_FILE = 50_000
#: Bytes of a file in which chains are followed where they are read.
WINDOW = 4 << 20
#: Records that are read again in one pass; their places are broadcast.
AGAIN = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

CANDIDATE = "file string, start bigint, succ bigint, exit bigint, window bigint, whole boolean, type string, id string, uri string, digest string, refers string, payload_bytes bigint, payload_digest string"
_EXTRA = [("whole", pa.bool_()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """id, url, html, bytes, digest, type and refers of each page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.filter(F.col("bytes") >= least_revisit).select("id", "digest")
    # Only payloads that repeat; written down, so that a hot one can be split when it is joined.
    repeated = stored(large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first"), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = (F.col("bytes") >= least_revisit) & F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    return rows.select("id", "url", "html", "bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("first")).alias("refers"))


def record(date: str = DATE) -> Column:
    """The record of a row of plan_records(), but for the line end that closes it."""
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("type"), F.lit("\r\nWARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("refers"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        http, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, *, date: str = DATE, per_file: int = RECORDS_PER_FILE, **columns) -> None:
    """Write the pages as WARC files under `path`."""
    rows = plan_records(pages, **columns).select(record(date).alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _number(text: str | bytes) -> int | None:
    """A length, or None for what is none."""
    text = text.strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def _fields(head: bytes) -> dict[str, str] | None:
    """The named fields of a record's head, or None if it is no head."""
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or b" " in name:
            return None
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out if "warc-type" in out and _number(out.get("content-length", "")) is not None else None


def _head(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """The fields of the record that a piece begins, and where its block begins and ends; None if it begins none.

    A head holds no version line, so it stands in one piece.
    """
    if not piece.startswith(VERSIONS):
        return None
    end = piece.find(b"\r\n\r\n")
    fields = _fields(piece[3:end]) if end >= 0 else None
    return (fields, end + 4, end + 4 + _number(fields["content-length"])) if fields else None


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "application/http").lower().startswith("application/http")


def _candidate(start: int, piece: bytes) -> dict:
    """The row of the candidate at `start`."""
    found = _head(piece)
    if found is None:
        return {"start": start, "succ": -1}
    h, body, end = found
    digest, revisit = h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"] == "revisit"
    row = {"start": start, "succ": start + len(SPLIT) + end + 4, "whole": revisit or len(piece) >= end, "type": h["warc-type"], "id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"), "digest": digest, "refers": h.get("warc-refers-to")}
    if revisit:
        lines = piece[body:end].partition(b"\r\n\r\n")[0].split(b"\r\n")
        said = next((_number(x.partition(b":")[2]) for x in lines if x.lower().startswith(b"content-length:")), None)
        return row | {"payload_bytes": said, "payload_digest": digest}
    if row["whole"]:
        payload = piece[body:end].partition(b"\r\n\r\n")[2] if _is_http(h) else piece[body:end]
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    return row


class _Payload:
    """Length and digest of a record's payload, from its pieces; none of them is held."""

    def __init__(self, piece: bytes) -> None:
        fields, body, end = _head(piece)
        self.left, self.size, self.hash = end - body, 0, hashlib.sha1()
        self.tail: bytes | None = b"" if _is_http(fields) else None  # of the inner head, while that lasts
        self.add(piece[body:])

    def add(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if self.tail is not None:
            both = self.tail + data
            at = both.find(b"\r\n\r\n")
            self.tail, data = (None, both[at + 4 :]) if at >= 0 else (both[-3:], b"")
        self.size += len(data)
        self.hash.update(data)


def _windowed(rows: list[dict], window: int) -> None:
    """Set `exit` of a window's candidates: where its chain leaves the window."""
    exits: dict[int, int] = {}
    for row in reversed(rows):
        row["window"] = row["start"] // window
        row["exit"] = exits[row["start"]] = exits.get(row["succ"], row["succ"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """Files, places and pieces: what follows each SPLIT, up to the next."""
    file, position = None, 0
    for batch in batches:
        for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != file:  # what stands before the first
                file, position = name, len(value)
                continue
            yield file, position, value
            position += len(SPLIT) + len(value)


def _scan(window: int):
    def batch_of(file: str, rows: list[dict]) -> pa.RecordBatch:
        _windowed(rows, window)
        numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in ("start", "succ", "exit", "window")]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *numbers, *(pa.array([r.get(c) for r in rows], t) for c, t in _EXTRA)], names=["file", "start", "succ", "exit", "window", *(c for c, _ in _EXTRA)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for file, start, piece in _pieces(batches):
            if (file, start // window) != key:
                if rows:
                    yield batch_of(key[0], rows)
                key, rows = (file, start // window), []
            rows.append(_candidate(start, piece))
        if rows:
            yield batch_of(key[0], rows)

    return scan


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The archives under `path`, cut at SPLIT; a file is read in one task."""
    bound_batches(spark)
    lines = spark.read.option("lineSep", SPLIT).text(path)
    plain = next((f for f in lines.inputFiles() if not f.endswith(".gz")), None)
    if plain:
        raise ValueError(f"not gzip-compressed: {plain}")
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))


def candidates(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """All candidate records of the archives under `path`."""
    return _lines(spark, path).mapInArrow(_scan(window), CANDIDATE)


def _read_again(spark: SparkSession, path: str, wanted: DataFrame, at_once: int) -> DataFrame:
    """file, start, payload_bytes and payload_digest of the records in `wanted`, which don't overlap; without truncated ones."""
    parts = None
    rounds = max(1, -(-wanted.count() // at_once))
    for k in range(rounds):
        places: dict[str, set[int]] = {}
        for r in wanted.filter(F.pmod(F.xxhash64("file", "start"), F.lit(rounds)) == k).toLocalIterator():
            places.setdefault(r.file, set()).add(r.start)
        known = spark.sparkContext.broadcast(places)

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            opened: tuple[str, int, _Payload] | None = None
            for file, start, piece in _pieces(batches):
                if opened and opened[0] != file:
                    opened = None
                if opened:
                    opened[2].add(SPLIT.encode() + piece)
                elif start in known.value.get(file, ()):
                    opened = file, start, _Payload(piece)
                if opened and not opened[2].left:
                    name, at, p = opened
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([p.size], pa.int64()), pa.array([p.hash.hexdigest()])], names=["file", "start", "payload_bytes", "payload_digest"])
                    opened = None

        found = _lines(spark, path).mapInArrow(scan, "file string, start bigint, payload_bytes bigint, payload_digest string")
        parts = found if parts is None else parts.unionAll(found)
    return parts


def reachable(found: DataFrame) -> DataFrame:
    """The candidates, stored, that the chain from the start of their file reaches."""
    # Entries: the start, and places where some chain leaves a window for another.
    exits = found.select("file", F.col("exit").alias("start")).distinct()
    jumps = stored(found.join(exits, ["file", "start"], "left_semi").unionAll(found.filter("start = 0")).select("file", "start", "exit").distinct(), "jumps")
    reached = stored(jumps.filter("start = 0").select("file", "start"), "reached")
    size = reached.count()
    while size:
        ahead = reached.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reached = stored(reached.unionAll(ahead).distinct(), "reached")
        grown = reached.count()
        if grown == size:
            break
        size = grown
        then = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("then"))
        jumps = stored(jumps.join(then, ["file", "exit"], "left").select("file", "start", F.coalesce("then", "exit").alias("exit")), "jumps")
    entries = reached.join(found.select("file", "start", "window"), ["file", "start"]).groupBy("file", "window").agg(F.min("start").alias("entry"))
    walk = found.select("file", "window", "start", "succ").join(entries, ["file", "window"])

    def follow(table: pa.Table) -> pa.Table:
        """The starts of one window that its entry's chain meets; a window has a bounded number of bytes."""
        after = dict(zip(table.column("start").to_pylist(), table.column("succ").to_pylist(), strict=True))
        at, met = table.column("entry")[0].as_py() if len(table) else -1, []
        while at in after and after[at] > at:
            met.append(at)
            at = after[at]
        return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(met), pa.string()), "start": pa.array(met, pa.int64())})

    kept = walk.groupBy("file", "window").applyInArrow(follow, "file string, start bigint")
    return found.join(kept, ["file", "start"], "left_semi")


def read_archives(spark: SparkSession, path: str, window: int = WINDOW, at_once: int = AGAIN) -> DataFrame:
    """The records of the archives under `path`: CANDIDATE's columns."""
    true = stored(reachable(stored(candidates(spark, path, window), "candidates")), "records")
    parted = true.filter("not whole")
    if parted.isEmpty():
        return true
    rest = [c for c in true.columns if c not in ("payload_bytes", "payload_digest")]
    again = stored(_read_again(spark, path, parted.select("file", "start"), at_once), "again")
    return true.filter("whole").unionByName(parted.select(*rest).join(again, ["file", "start"]))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    with scratch() as keep:
        write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
        out = stored(read_archives(spark, path), "found")
        keep(out)

    def page(c: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")

    return out.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", page("refers")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS first, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN c > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""
