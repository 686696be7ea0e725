"""Spaces, locations and what is registered about them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import InvalidProperty, NotFound

ANALYTICAL, TRANSACTIONAL, REMOTE = "analytical", "transactional", "remote"
#: Snapshot tables of Parquet files; tables with row changes by version; an embedded row-store file; another root; a copy of one; frames of this process.
SNAPSHOTS, VERSIONED, ROWSTORE, PEER, REPLICA, MEMORY = "snapshots", "versioned", "rowstore", "peer", "replica", "memory"
#: Names that statements may use for formats and engines. Queries always run in Spark.
FORMATS = {"iceberg": SNAPSHOTS, "parquet": SNAPSHOTS, "snapshots": SNAPSHOTS, "lance": VERSIONED, "versioned": VERSIONED}
ENGINES = {"duckdb": "columnar", "columnar": "columnar", "sqlite": "row", "row": "row"}
ACCESS = {"writable": "writable", "readwrite": "writable", "rw": "writable", "readonly": "readonly", "read_only": "readonly", "ro": "readonly"}
READS = {"columnar": {SNAPSHOTS, VERSIONED, ROWSTORE, REPLICA}, "row": {ROWSTORE}, "peer": {PEER}}

_NAME = re.compile(r"[A-Za-z_\-][A-Za-z0-9_\-]*")


def check_name(name: str) -> str:
    """Names are letters, digits, _ and -, and don't start with a digit."""
    if not _NAME.fullmatch(name or ""):
        raise InvalidProperty(f"invalid name '{name}'")
    return name


def one_of(what: str, value: str, allowed: dict[str, str]) -> str:
    if value.lower() not in allowed:
        raise InvalidProperty(f"unknown {what} '{value}' (expected one of {', '.join(sorted(allowed))})")
    return allowed[value.lower()]


@dataclass
class Location:
    """Where data lies. Many spaces may read it, one may write."""

    id: str
    format: str
    path: str
    writer: str | None = None
    owner: str | None = None
    remote: str | None = None


@dataclass
class Space:
    name: str
    kind: str
    engine: str
    location: str
    access: str
    published_from: str | None = None
    created_ms: int = 0

    @property
    def writable(self) -> bool:
        return self.access == "writable"


@dataclass
class View:
    space: str
    name: str
    query: str


@dataclass
class Grant:
    principal: str
    space: str
    relation: str
    columns: list[str] | None = None


@dataclass
class Policy:
    space: str
    relation: str
    name: str
    principals: list[str]
    predicate: str


@dataclass
class VertexTable:
    table: str
    label: str
    key: str | None = None


@dataclass
class EdgeTable:
    table: str
    label: str
    source_key: str
    source_table: str
    source_ref: str
    target_key: str
    target_table: str
    target_ref: str


@dataclass
class Graph:
    space: str
    name: str
    vertices: list[VertexTable]
    edges: list[EdgeTable] = field(default_factory=list)


@dataclass
class VirtualTable:
    """A full-text (`fts5`) or vector (`vec0`) table of a transactional space."""

    space: str
    name: str
    module: str
    columns: list[str]
    options: dict[str, str]


@dataclass
class Index:
    space: str
    table: str
    name: str
    type: str
    column: str
    options: dict[str, str]


@dataclass
class SpaceRequest:
    """The properties of a CREATE SPACE statement."""

    name: str
    kind: str | None = None
    engine: str | None = None
    location: str | None = None
    access: str | None = None
    storage: str | None = None
    format: str | None = None
    peer: str | None = None
    remote: str | None = None
    token: str | None = None
    mode: str | None = None


def bind(request: SpaceRequest, locations: dict[str, Location], root: str) -> tuple[Space, Location, bool]:
    """The space and location that a request makes or joins, and whether the location is new.

    A new location is named after the space. A transactional space needs a row-store file and writes it; an analytical space only reads one,
    and reads other locations that exist unless it asks to write. A location has one writer at most. Locations of
    peers are bound by their own statement only.
    """
    check_name(request.name)
    if request.storage and request.storage.lower() != "disk":
        raise InvalidProperty(f"unknown storage '{request.storage}' (expected 'disk')")
    kind = request.kind or ANALYTICAL
    if kind == REMOTE:
        raise InvalidProperty("spaces of peers are made with a token")
    engine = request.engine or ("row" if kind == TRANSACTIONAL else "columnar")
    new = request.location is None
    if new:
        if request.format and kind != ANALYTICAL:
            raise InvalidProperty("FORMAT is only for a new analytical space")
        form = ROWSTORE if kind == TRANSACTIONAL else (request.format or SNAPSHOTS)
        if request.name in locations:
            raise InvalidProperty(f"a location '{request.name}' exists: bind it with LOCATION = '{request.name}'")
        location = Location(request.name, form, f"{root}/{form}/{request.name}" + (".sqlite" if form == ROWSTORE else ""))
    else:
        if request.format:
            raise InvalidProperty("FORMAT is only for a new analytical space")
        if request.location not in locations:
            raise NotFound("Location", request.location)
        location = locations[request.location]
        if location.format in (PEER, REPLICA):
            raise InvalidProperty(f"location '{location.id}' belongs to a peer and cannot be bound again")
    if kind == TRANSACTIONAL:
        if location.format != ROWSTORE:
            raise InvalidProperty(f"a {kind} space cannot live in location {location.id}, which holds {location.format}")
        access = request.access or "writable"
        if access != "writable":
            raise InvalidProperty("a transactional space is always writable")
    elif location.format == ROWSTORE:
        if request.access == "writable":
            raise InvalidProperty("an analytical space only reads a row store")
        access = "readonly"
    else:
        access = request.access or ("writable" if new else "readonly")
    if location.format not in READS[engine]:
        raise InvalidProperty(f"the {engine} engine does not read {location.format} locations")
    if access == "writable" and location.writer and location.writer != request.name:
        raise InvalidProperty(f"location {location.id} is written by space {location.writer}")
    return Space(request.name, kind, engine, location.id, access), location, new


