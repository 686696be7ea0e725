"""The registry: spaces, locations, views, grants, policies, graphs, virtual tables, indexes and tokens, kept as one JSON file."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, replace

from .errors import AlreadyExists, EngineError, NotFound
from .fs import FileSystem
from .model import EdgeTable, Grant, Graph, Index, Location, Policy, Space, SpaceRequest, VertexTable, View, VirtualTable, bind

VERSION = 1


class Registry:
    """In memory, and on disk under `root` unless that is None. Changes are written at once, whole, by renaming."""

    def __init__(self, fs: FileSystem | None = None, root: str | None = None) -> None:
        self.fs, self.root = fs, root
        self.spaces: dict[str, Space] = {}
        self.locations: dict[str, Location] = {}
        self.views: dict[tuple[str, str], View] = {}
        self.grants: dict[tuple[str, str, str], Grant] = {}
        self.policies: dict[tuple[str, str, str], Policy] = {}
        self.graphs: dict[tuple[str, str], Graph] = {}
        self.virtual: dict[tuple[str, str], VirtualTable] = {}
        self.indexes: dict[tuple[str, str, str], Index] = {}
        self.tokens: dict[str, dict] = {}
        self.peers: dict[str, dict] = {}
        self._seen: str | None = None
        #: Spaces of this process alone, which are not written down.
        self.held: dict[str, tuple[Space, Location]] = {}
        self.refresh()

    @property
    def path(self) -> str | None:
        return f"{self.root}/registry.json" if self.root else None

    def refresh(self) -> None:
        """Read the file again if another session changed it."""
        if not self.path or not self.fs.exists(self.path):
            return
        text = self.fs.read(self.path)
        if text == self._seen:
            return
        data = json.loads(text)
        if data.get("version") != VERSION:
            raise EngineError(f"registry version {data.get('version')} is not {VERSION}")
        self._seen = text
        self.spaces = {s["name"]: Space(**s) for s in data["spaces"]}
        self.locations = {x["id"]: Location(**x) for x in data["locations"]}
        for space, location in self.held.values():
            self.spaces[space.name], self.locations[location.id] = space, location
        self.views = {(v["space"], v["name"]): View(**v) for v in data["views"]}
        self.grants = {(g["principal"], g["space"], g["relation"]): Grant(**g) for g in data["grants"]}
        self.policies = {(p["space"], p["relation"], p["name"]): Policy(**p) for p in data["policies"]}
        self.graphs = {(g["space"], g["name"]): Graph(g["space"], g["name"], [VertexTable(**v) for v in g["vertices"]], [EdgeTable(**e) for e in g["edges"]]) for g in data["graphs"]}
        self.virtual = {(v["space"], v["name"]): VirtualTable(**v) for v in data["virtual"]}
        self.indexes = {(i["space"], i["table"], i["name"]): Index(**i) for i in data["indexes"]}
        self.tokens, self.peers = data["tokens"], data["peers"]

    def save(self) -> None:
        if not self.path:
            return
        kinds = ("spaces", "locations", "views", "grants", "policies", "graphs", "virtual", "indexes")
        own = {x.name for x, _ in self.held.values()} | {x.id for _, x in self.held.values()}
        data = {"version": VERSION} | {k: [asdict(x) for x in getattr(self, k).values() if not {getattr(x, "id", None), x.name if k == "spaces" else None} & own] for k in kinds} | {"tokens": self.tokens, "peers": self.peers}
        self._seen = json.dumps(data, indent=1)
        self.fs.write(self.path, self._seen, overwrite=True)

    def space(self, name: str) -> Space:
        if name not in self.spaces:
            raise NotFound("Space", name)
        return self.spaces[name]

    def location(self, space: Space | str) -> Location:
        space = self.space(space) if isinstance(space, str) else space
        return self.locations[space.location]

    def create_space(self, request: SpaceRequest, root: str) -> Space:
        if request.name in self.spaces:
            raise AlreadyExists("Space", request.name)
        space, location, _ = bind(request, self.locations, root)
        return self.add_space(space, location)

    def add_space(self, space: Space, location: Location) -> Space:
        if space.name in self.spaces:
            raise AlreadyExists("Space", space.name)
        space.created_ms = int(time.time() * 1000)
        if space.writable:
            location.writer = space.name
        self.spaces[space.name], self.locations[location.id] = space, location
        self.save()
        return space

    def hold(self, space: Space, location: Location) -> Space:
        """Add a space for this process alone."""
        if space.name in self.spaces:
            raise AlreadyExists("Space", space.name)
        self.held[space.name] = space, location
        self.spaces[space.name], self.locations[location.id] = space, location
        return space

    def drop_space(self, name: str) -> Location:
        """Forget a space and all that is registered on it. Its data and location stay, but for locations of peers."""
        space = self.space(name)
        location = self.locations[space.location]
        if location.writer == name:
            location.writer = None
        if location.format in ("peer", "replica", "memory"):
            del self.locations[location.id]
        del self.spaces[name]
        self.held.pop(name, None)
        for kind in ("views", "grants", "policies", "graphs", "virtual", "indexes"):
            setattr(self, kind, {k: x for k, x in getattr(self, kind).items() if x.space != name})
        self.save()
        return location

    def drop_relation(self, space: str, name: str) -> None:
        """Forget the grants, policies and indexes of a relation."""
        self.grants = {k: g for k, g in self.grants.items() if (g.space, g.relation) != (space, name)}
        self.policies = {k: p for k, p in self.policies.items() if (p.space, p.relation) != (space, name)}
        self.indexes = {k: i for k, i in self.indexes.items() if (i.space, i.table) != (space, name)}
        self.save()

    def rename_relation(self, space: str, name: str, to: str) -> None:
        """Grants, policies and indexes of a relation under its new name."""
        self.grants = {(p, s, to if (s, r) == (space, name) else r): replace(g, relation=to) if (s, r) == (space, name) else g for (p, s, r), g in self.grants.items()}
        self.policies = {(s, to if (s, r) == (space, name) else r, n): replace(p, relation=to) if (s, r) == (space, name) else p for (s, r, n), p in self.policies.items()}
        self.indexes = {(s, to if (s, t) == (space, name) else t, n): replace(i, table=to) if (s, t) == (space, name) else i for (s, t, n), i in self.indexes.items()}
        self.save()

    def grant_of(self, principal: str, space: str, relation: str) -> Grant | None:
        return self.grants.get((principal, space, relation))

    def policies_on(self, space: str, relation: str) -> list[Policy]:
        return [p for p in self.policies.values() if (p.space, p.relation) == (space, relation)]
