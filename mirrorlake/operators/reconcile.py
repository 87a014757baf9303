"""Proof that source and target are equal, and repair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from mirrorlake.operators.digest import digest, mismatches


@dataclass
class TableSpec:
    schema: str
    table: str
    types: dict[str, str]
    key: list[str]


@dataclass
class Audit:
    at: datetime
    table: str
    result: str
    mismatched_buckets: int
    detail: str = ""


@dataclass
class Reconciler:
    """Digest both sides of every table; ``repair`` is called at most once a ``repair_every``."""

    source: Callable[[TableSpec], DataFrame]
    target: Callable[[TableSpec], DataFrame]
    tables: list[TableSpec]
    buckets: int = 256
    auto_repair: bool = False
    dry_run: bool = False
    repair_every: timedelta = timedelta(hours=24)
    repair: Callable[[], None] = lambda: None
    drained: Callable[[], bool] = lambda: True
    audits: list[Audit] = field(default_factory=list)

    def run(self, now: datetime) -> str:
        if not self.drained():
            self.audits.append(Audit(now, "*", "error", 0, "the log isn't drained"))
            return "error"
        total = 0
        for spec in self.tables:
            one = lambda df, s=spec: digest(df, s.schema, s.table, s.types, s.key, self.buckets)
            n = mismatches(one(self.source(spec)), one(self.target(spec)))
            total += n
            self.audits.append(Audit(now, f"{spec.schema}.{spec.table}", "mismatch" if n else "match", n))
        if not total:
            return "match"
        lately = any(a.result == "repair" and now - a.at < self.repair_every for a in self.audits)
        if not self.auto_repair or self.dry_run or lately:
            return "mismatch"
        self.repair()
        self.audits.append(Audit(now, "*", "repair", total))
        return "repair"


def due(now: datetime, daily_at: time, zone: str, last_run: datetime | None, last_failed: bool = False) -> bool:
    """Once a day from ``daily_at`` local time on; five minutes after a failure again."""
    if last_failed and last_run is not None:
        return now - last_run >= timedelta(minutes=5)
    local = now.astimezone(ZoneInfo(zone))
    start = local.replace(hour=daily_at.hour, minute=daily_at.minute, second=daily_at.second, microsecond=0)
    return local >= start and (last_run is None or last_run < start)
