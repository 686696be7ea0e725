"""What can go wrong, as exceptions."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this engine."""


class InvalidStatement(EngineError):
    """The text is no statement of the language."""


class InvalidProperty(EngineError):
    """A property, name or value that isn't allowed."""


class Unsupported(EngineError):
    """A statement or type that is refused."""


class NotFound(EngineError):
    """A named thing that isn't there."""

    def __init__(self, kind: str, name: str) -> None:
        super().__init__(f"{kind} not found: {name}")
        self.kind, self.name = kind, name


class AlreadyExists(EngineError):
    def __init__(self, kind: str, name: str) -> None:
        super().__init__(f"{kind} already exists: {name}")
        self.kind, self.name = kind, name


class AccessDenied(EngineError):
    """The principal, or the space's access mode, does not allow this."""


class CommitConflict(EngineError):
    """Another writer committed first, again and again."""


class ConformError(EngineError):
    """Rows that don't fit the table they are inserted into."""
