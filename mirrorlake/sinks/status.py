"""A status file for operators, replaced as a whole."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mirrorlake.sources.log import Log

NEARLY_FULL = 0.8


def status(log: Log, *, now: datetime | None = None, running: bool = True) -> dict:
    """Positions, backlog and room of a log; ``oldest_pending_at`` is null if all is delivered."""
    state = log.state()
    pending = state.ready_seq - state.delivered_seq
    oldest = log.read(state.delivered_seq + 1).agg(F.min("created_at")).first()[0] if pending else None
    used = sum(f[3] for f in state.folders)
    positions = {k: v for k, v in asdict(state).items() if k != "folders"}
    return {
        "updated_at": (now or datetime.now(timezone.utc)).isoformat(), "running": running, **positions, "pending": pending,
        "oldest_pending_at": oldest, "bytes": used, "max_bytes": log.max_bytes, "nearly_full": used >= NEARLY_FULL * log.max_bytes,
    }


def free_bytes(folder: str) -> int:
    return shutil.disk_usage(folder).free


def write_status(path: str, content: dict) -> None:
    draft = f"{path}.draft"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(content, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)
