"""Strict configuration: unknown names are errors, secrets come from the environment."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
from dataclasses import MISSING, dataclass, field, fields

ENGINES = ("postgres", "mysql", "sqlserver", "sqlserver-legacy", "files")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Capture:
    """What is captured; exactly these fields make the fingerprint."""

    engine: str
    source_id: str
    tables: tuple[str, ...] = ()
    slot: str = ""
    root: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    file_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limits:
    batch_rows: int = 500
    batch_bytes: int = 1 << 20
    max_row_bytes: int = 16 << 20
    queue_bytes: int = 10 << 30
    archive_hours: int = 168
    archive_bytes: int = 20 << 30
    chunk_bytes: int = 4 << 20
    max_file_bytes: int = 1 << 30
    buckets: int = 256


@dataclass(frozen=True)
class Config:
    capture: Capture
    limits: Limits = field(default_factory=Limits)
    password_env: str = ""

    def fingerprint(self) -> str:
        """Names the capture; operational limits don't change it."""
        c = self.capture
        scope = {f.name: sorted(v) if isinstance(v := getattr(c, f.name), tuple) else v for f in fields(c)}
        return hashlib.sha256(json.dumps(scope, sort_keys=True).encode()).hexdigest()

    def password(self) -> str:
        if not self.password_env:
            return ""
        if self.password_env not in os.environ:
            raise ConfigError(f"environment variable {self.password_env} is not set")
        return os.environ[self.password_env]


def _build(kind, data: dict):
    names = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(data) - set(names)):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    if missing := [n for n, f in names.items() if n not in data and f.default is MISSING and f.default_factory is MISSING]:
        raise ConfigError(f"missing settings: {', '.join(missing)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def load(text: str) -> Config:
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"not one JSON document: {e}") from None
    if not isinstance(data, dict):
        raise ConfigError("settings are a JSON object")
    data = dict(data)
    if "capture" not in data:
        raise ConfigError("missing settings: capture")
    parts = {"capture": _build(Capture, data.pop("capture")), "limits": _build(Limits, data.pop("limits", {}))}
    config = _build(Config, {**data, **parts})
    check(config)
    return config


def check(config: Config) -> None:
    c, n = config.capture, config.limits
    if c.engine not in ENGINES:
        raise ConfigError(f"engine {c.engine!r} is unknown")
    if not c.source_id or "/" in c.source_id:
        raise ConfigError("source_id is empty or has a slash")
    if c.engine == "files":
        if not c.root or c.tables:
            raise ConfigError("a file capture has a root and no tables")
    elif not c.tables or len(set(c.tables)) != len(c.tables) or any(t.count(".") != 1 for t in c.tables):
        raise ConfigError("tables are distinct schema.table names")
    if c.engine == "postgres" and not c.slot:
        raise ConfigError("a slot is needed")
    if any(getattr(n, f.name) < 1 for f in fields(n)):
        raise ConfigError("limits are positive")
    if n.batch_bytes > n.queue_bytes or n.max_row_bytes > n.queue_bytes:
        raise ConfigError("a batch or row doesn't fit the queue")


@dataclass(frozen=True)
class Storage:
    """Where a capture's files go: a folder, or a bucket of an endpoint, and a prefix in it."""

    backend: str
    place: str
    prefix: str = ""
    endpoint: str = ""

    def parts(self) -> tuple:
        """Path parts that start with what names the store."""
        if self.backend == "directory":
            return ("directory", *[p for p in os.path.abspath(os.path.join(self.place, self.prefix)).split(os.sep) if p])
        return ("object", self.endpoint.lower(), self.place, *[p for p in posixpath.normpath("/" + self.prefix).split("/") if p])


def storage_overlaps(storages: dict[str, Storage]) -> list[tuple[str, str]]:
    """Pairs of captures of which one's folder is, or holds, the other's."""
    named = sorted((s.parts(), name) for name, s in storages.items())
    return sorted(tuple(sorted((a, b))) for i, (p, a) in enumerate(named) for q, b in named[i + 1 :] if q[: len(p)] == p)


def target_overlaps(targets: dict[str, tuple[str, str, list[str]]]) -> list[tuple[str, str, str]]:
    """(table, first, other) where two captures write one table; a target is the instance's id, its schema and the tables."""
    owner, found = {}, []
    for name, (instance, schema, tables) in sorted(targets.items()):
        for table in tables:
            first = owner.setdefault((instance, schema, table), name)
            if first != name:
                found.append((f"{schema}.{table}", first, name))
    return found
