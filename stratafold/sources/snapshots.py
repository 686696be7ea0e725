"""Versioned tables: Parquet files, and a log of snapshots that name them.

A table is a folder with `data/` and `log/`. Each commit adds `log/<version>.json`, made by exclusive creation, so of two writers one
succeeds and the other reads the new state and tries again. A snapshot lists manifests, each a list of data files; an append
adds one manifest and rewrites none. Files of a table that was registered stay where they are, under their whole paths.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, ConformError, EngineError, NotFound
from ..fs import FileSystem

TRIES = 5
#: Bytes that compaction aims at for a file, and rows after which a writer starts a new one.
TARGET_BYTES = 128 << 20
ROWS_PER_FILE = 1 << 22


@dataclass
class Snapshot:
    version: int
    id: int | None  #: None until there is data
    schema: T.StructType
    operation: str
    manifests: list[str] = field(default_factory=list)
    parent: int | None = None
    ms: int = 0
    streams: dict[str, int] = field(default_factory=dict)  #: last batch that came in from each stream


class Table:
    """One table: its log, and frames over its snapshots."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.fs, self.path = spark, FileSystem(spark), path.rstrip("/")
        self.name = self.path.rsplit("/", 1)[-1]

    # The log

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self.fs.list(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, pin: int | None = None) -> Snapshot:
        """The latest snapshot, or the one with id `pin`."""
        versions = self.versions()
        if not versions:
            raise NotFound("Table", self.name)
        for v in reversed(versions):
            s = self._read(v)
            if pin is None or s.id == pin:
                return s
        raise NotFound("Snapshot", f"{self.name}@{pin}")

    def at_version(self, version: int) -> Snapshot:
        if version not in self.versions():
            raise NotFound("Version", f"{self.name}@{version}")
        return self._read(version)

    def history(self) -> list[Snapshot]:
        return [self._read(v) for v in self.versions()]

    def _read(self, version: int) -> Snapshot:
        d = self.fs.read_json(f"{self.path}/log/{version:012d}.json")
        return Snapshot(d["version"], d["id"], T.StructType.fromJson(d["schema"]), d["operation"], d["manifests"], d["parent"], d["ms"], d["streams"])

    def _commit(self, make: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
        """Add the snapshot that make() gives for the last one; made anew after each conflict. None: there is nothing to add."""
        for _ in range(TRIES):
            last = self.snapshot()
            new = make(last)
            if new is None:
                return last
            new.version, new.parent, new.ms = last.version + 1, last.id, int(time.time() * 1000)
            new.streams = last.streams | new.streams
            if self._create(new):
                return new
        raise CommitConflict(f"{self.name}: another writer committed first, {TRIES} times")

    def _create(self, s: Snapshot) -> bool:
        data = {"version": s.version, "id": s.id, "schema": s.schema.jsonValue(), "operation": s.operation, "manifests": s.manifests, "parent": s.parent, "ms": s.ms, "streams": s.streams}
        return self.fs.write(f"{self.path}/log/{s.version:012d}.json", json.dumps(data))

    # Files

    def entries(self, snapshot: Snapshot) -> list[dict]:
        """The data files of a snapshot: file, bytes and, for published ones, sha256."""
        return [f for m in snapshot.manifests for f in self.fs.read_json(f"{self.path}/log/{m}")]

    def place(self, file: str) -> str:
        return file if file.startswith("/") or "://" in file else f"{self.path}/data/{file}"

    def files(self, snapshot: Snapshot) -> list[str]:
        return [self.place(f["file"]) for f in self.entries(snapshot)]

    def _manifest(self, files: list[dict]) -> list[str]:
        if not files:
            return []
        name = f"manifest-{uuid.uuid4().hex}.json"
        self.fs.write(f"{self.path}/log/{name}", json.dumps(files))
        return [name]

    def _write(self, df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> list[dict]:
        """Write data files, not yet part of any snapshot."""
        part = uuid.uuid4().hex
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/data/{part}")
        return [{"file": f"{part}/{n}", "bytes": size} for n, size in self.fs.list(f"{self.path}/data/{part}") if n.endswith(".parquet")]

    # Operations

    def create(self, schema: T.StructType, if_not_exists: bool = False) -> "Table":
        first = Snapshot(1, None, schema, "create", ms=int(time.time() * 1000))
        if not self._create(first) and not if_not_exists:
            from ..errors import AlreadyExists

            raise AlreadyExists("Table", self.name)
        return self

    def exists(self) -> bool:
        return bool(self.versions())

    def frame(self, pin: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of a snapshot; its files are fixed when this is called."""
        s = snapshot or self.snapshot(pin)
        files = self.files(s)
        if not files:
            return self.spark.createDataFrame([], s.schema)
        return self.spark.read.schema(s.schema).parquet(*files)

    def append(self, df: DataFrame) -> Snapshot:
        """Add rows, all in one snapshot. The rows must have the table's columns; see conform()."""
        added = self._manifest(self._write(df))
        return self._commit(lambda last: Snapshot(0, _new_id(), last.schema, "append", [*last.manifests, *added]))

    def append_batch(self, df: DataFrame, stream: str, batch: int) -> Snapshot:
        """Add a batch of a stream, once: a batch that is in the table already isn't added again, by whichever run it came in."""

        def seen(s: Snapshot) -> bool:
            return s.streams.get(stream, -1) >= batch

        if seen(last := self.snapshot()):
            return last
        files = self._write(df)
        added = self._manifest(files)
        done = self._commit(lambda last: None if seen(last) else Snapshot(0, _new_id(), last.schema, "append", [*last.manifests, *added], streams={stream: batch}))
        if not set(added) <= set(done.manifests):  # another run of the batch came first
            for folder in {f["file"].split("/")[0] for f in files}:
                self.fs.delete(f"{self.path}/data/{folder}")
        return done

    def overwrite(self, df: DataFrame | None, schema: T.StructType | None = None, operation: str = "overwrite", rows_per_file: int = ROWS_PER_FILE, hashed: bool = False) -> Snapshot:
        """Replace all rows; none if `df` is None. hashed: record a hash of each file."""
        files = self._write(df, rows_per_file) if df is not None else []
        if hashed and files:
            sums = digests(self.spark, [self.place(f["file"]) for f in files])
            files = [f | {"sha256": sums[_tail(f["file"])]} for f in files]
        added = self._manifest(files)
        return self._commit(lambda last: Snapshot(0, _new_id(), schema or last.schema, operation, added))

    def register(self, paths: list[str]) -> "Table":
        """Make this table of Parquet files that exist; they stay where they are."""
        files = [{"file": f"{p.rstrip('/')}/{n}" if n != p.rsplit("/", 1)[-1] else p, "bytes": size} for p in paths for n, size in self.fs.list(p) if n.endswith(".parquet")]
        if not files:
            raise NotFound("Files", ", ".join(paths))
        self.create(self.spark.read.parquet(*(f["file"] for f in files)).schema)
        added = self._manifest(files)
        self._commit(lambda last: Snapshot(0, _new_id(), last.schema, "register", added))
        return self

    def compact(self, target_bytes: int = TARGET_BYTES) -> Snapshot:
        """Rewrite the current snapshot into files of about `target_bytes`."""
        last = self.snapshot()
        if last.id is None:
            raise EngineError("no snapshot to compact")
        sizes = [f["bytes"] for f in self.entries(last)]
        if not sizes:
            raise EngineError("no rows to compact")
        count = max(1, -(-sum(sizes) // target_bytes))
        return self._swap(last, self.frame(snapshot=last).repartition(count), "compact")

    def _swap(self, seen: Snapshot, df: DataFrame | None, operation: str, kept: list[dict] = (), schema: T.StructType | None = None) -> Snapshot:
        """Replace the files of a snapshot that was read; a conflict if another commit came between."""
        files = self._manifest([*kept, *(self._write(df) if df is not None else [])])
        new = Snapshot(seen.version + 1, _new_id(), schema or seen.schema, operation, files, seen.id, int(time.time() * 1000), seen.streams)
        if not self._create(new):
            raise CommitConflict(f"{self.name} was changed while {operation} ran")
        return new

    # Row changes, by rewriting the files that hold rows to change

    def _touched(self, s: Snapshot, met: DataFrame) -> tuple[list[str], list[dict]]:
        """Files that rows of `met`, with the file in _file, came from, and the other files."""
        names = {_tail(r["_file"]) for r in met.select("_file").distinct().collect()}  # as many as files at most
        every = self.entries(s)
        return [self.place(f["file"]) for f in every if _tail(f["file"]) in names], [f for f in every if _tail(f["file"]) not in names]

    def _with_places(self, s: Snapshot) -> DataFrame:
        """The rows of a snapshot with _file and _at, their place in it, which tells rows apart however often they are read."""
        files = self.files(s)
        if not files:
            return self.spark.createDataFrame([], T.StructType([*s.schema.fields, T.StructField("_file", T.StringType()), T.StructField("_at", T.LongType())]))
        return self.spark.read.schema(s.schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    def delete(self, condition: str | None) -> int:
        """Delete the rows that meet the condition; how many."""
        s = self.snapshot()
        condition = condition or "true"
        touched, kept = self._touched(s, self._with_places(s).filter(condition))
        if not touched:
            return 0
        rows = self.spark.read.schema(s.schema).parquet(*touched)
        count = rows.filter(condition).count()
        self._swap(s, rows.filter(f"NOT coalesce(({condition}), false)"), "delete", kept)
        return count

    def update(self, values: dict[str, str], condition: str | None) -> int:
        """Set columns, by expressions over the old row, where the condition holds; how many rows."""
        s = self.snapshot()
        condition = condition or "true"
        touched, kept = self._touched(s, self._with_places(s).filter(condition))
        if not touched:
            return 0
        unknown = set(values) - {f.name for f in s.schema.fields}
        if unknown:
            raise NotFound("Column", sorted(unknown)[0])
        rows = self.spark.read.schema(s.schema).parquet(*touched)
        count = rows.filter(condition).count()
        met = F.coalesce(F.expr(condition), F.lit(False))
        out = rows.select(*(F.when(met, F.expr(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in s.schema.fields))
        self._swap(s, out, "update", kept)
        return count

    def merge(self, source: DataFrame, alias: str, source_alias: str, on: str, clauses: list["MergeClause"]) -> int:
        """Merge a source into the table; how many rows were changed, deleted or added. A row that several source rows meet is an error.

        Only files with rows that meet source rows are rewritten, or all if rows are asked for that meet none.
        """
        s = self.snapshot()
        names, own = [f.name for f in s.schema.fields], uuid.uuid4().hex[:8]
        # Names that clash with none of the table's or the source's.
        file, at, there, given, action = (f"_{n}_{own}" for n in ("file", "at", "there", "given", "action"))
        source = source.withColumn(given, F.lit(True)).checkpoint().alias(source_alias)
        target = self._with_places(s).withColumnRenamed("_file", file).withColumnRenamed("_at", at)
        if any(c.when == "not matched by source" for c in clauses):
            kept = []
        else:
            met = target.alias(alias).join(source, F.expr(on)).select(F.col(f"{alias}.{file}").alias("_file"))
            touched, kept = self._touched(s, met)
            names_of = {_tail(f) for f in touched}
            target = target.filter(F.substring_index(file, "/", -2).isin(sorted(names_of))) if names_of else target.limit(0)
        both = target.withColumn(there, F.lit(True)).alias(alias).join(source, F.expr(on), "full_outer")
        is_there, is_given = F.col(there).isNotNull(), F.col(given).isNotNull()
        chosen, values = F.lit(None).cast("int"), {n: F.col(f"{alias}.{n}") for n in names}
        for k, c in reversed(list(enumerate(clauses))):
            when = {"matched": is_there & is_given, "not matched": ~is_there & is_given, "not matched by source": is_there & ~is_given}[c.when]
            if c.condition:
                when = when & F.coalesce(F.expr(c.condition), F.lit(False))
            chosen = F.when(when, F.lit(k)).otherwise(chosen)
        both = both.withColumn(action, chosen)
        for n, f in zip(names, s.schema.fields, strict=True):
            for k, c in enumerate(clauses):
                if c.action == "update" and n in c.values:
                    values[n] = F.when(F.col(action) == k, F.expr(c.values[n]).cast(f.dataType)).otherwise(values[n])
                elif c.action == "insert":
                    values[n] = F.when(F.col(action) == k, F.expr(c.values[n]).cast(f.dataType) if n in c.values else F.lit(None).cast(f.dataType)).otherwise(values[n])
        # The join is run once; what follows reads its result.
        both = both.select(*(values[n].alias(n) for n in names), file, at, is_there.alias(there), is_given.alias(given), action).checkpoint()
        acted = F.col(action).isNotNull()
        if not both.filter(F.col(there) & F.col(given) & acted).groupBy(file, at).count().filter("count > 1").isEmpty():
            raise EngineError("MERGE: several source rows meet one row of the table")
        changed = both.filter(acted).count()
        deletes = [k for k, c in enumerate(clauses) if c.action == "delete"]
        gone = F.coalesce(F.col(action).isin(deletes), F.lit(False)) if deletes else F.lit(False)
        # Matches without an action keep the row once, however many source rows meet it.
        old = both.filter(F.col(there) & ~gone).dropDuplicates([file, at])
        new = both.filter(~F.col(there) & acted & ~gone)
        self._swap(s, old.unionAll(new).select(*names), "merge", kept)
        return changed

    def alter(self, schema: T.StructType, columns: list[tuple[str, str | None]]) -> Snapshot:
        """Change columns: `columns` gives (new name, old name or None) in order. Rewrites the files, as names and types are stored there."""
        s = self.snapshot()
        frame = self.frame(snapshot=s)
        types = {f.name: f.dataType for f in schema.fields}
        out = frame.select(*((F.col(old).cast(types[new]) if old else F.lit(None).cast(types[new])).alias(new) for new, old in columns))
        return self._swap(s, out if s.manifests else None, "alter", schema=schema)


@dataclass
class MergeClause:
    when: str  #: matched, not matched, not matched by source
    condition: str | None
    action: str  #: update, delete, insert, nothing
    values: dict[str, str] = field(default_factory=dict)


def _new_id() -> int:
    return uuid.uuid4().int >> 66


def _tail(path: str) -> str:
    """What tells data files apart: the folder of the write, and the name."""
    return "/".join(path.split("/")[-2:])


def digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of files, by folder and name; the files are read where tasks run."""
    rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sum"))
    return {_tail(r.path): r["sum"] for r in rows.collect()}


def conform(df: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Rows in the shape of a table: by the names in `columns` (any case) or else by position.

    Values are cast, and become null where they can't be; a missing nullable column is null; a null in a required
    column is an error, when the rows are written. Names that the table doesn't have are errors.
    """
    given = df.columns
    if columns is None:
        if len(given) != len(schema.fields):
            raise ConformError(f"expected {len(schema.fields)} columns, got {len(given)}")
        at = {f.name.lower(): i for i, f in enumerate(schema.fields)}
    else:
        if len(columns) != len(given):
            raise ConformError(f"{len(columns)} columns are named, {len(given)} given")
        at = {c.lower(): i for i, c in enumerate(columns)}
        known = {f.name.lower() for f in schema.fields}
        if len(at) != len(columns) or set(at) - known:
            raise ConformError(f"unknown or repeated column in ({', '.join(columns)})")
    df = df.toDF(*(f"_{i}" for i in range(len(given))))
    out = []
    for f in schema.fields:
        i = at.get(f.name.lower())
        if i is None:
            if not f.nullable:
                raise ConformError(f"column {f.name} is required")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"_{i}")
        value = c if df.schema[i].dataType == f.dataType else (c.try_cast(f.dataType) if isinstance(df.schema[i].dataType, T.AtomicType) else c.cast(f.dataType))
        if not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)
