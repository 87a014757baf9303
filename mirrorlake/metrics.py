"""Figures of the log, the target and streaming queries in the text exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Upper bounds of the latency histogram in seconds; fixed values.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(df: DataFrame, value: Column, bounds=BOUNDS) -> DataFrame:
    """le and cumulative count, one row for each bound and one for +Inf."""
    counts = df.agg(*[F.sum((value <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("inf"))
    pairs = F.array(*[F.struct(F.lit(str(float(b))).alias("le"), F.coalesce(f"b{i}", F.lit(0)).alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))
    return counts.select(F.inline(pairs))


def exposition(values: dict[str, float], labels: dict[str, str] | None = None, prefix: str = "mirrorlake") -> str:
    escape = lambda v: str(v).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")
    inner = ",".join(f'{k}="{escape(v)}"' for k, v in sorted((labels or {}).items()))
    return "".join(f"{prefix}_{name}{'{' + inner + '}' if inner else ''} {value:g}\n" for name, value in sorted(values.items()))


def log_values(state) -> dict[str, float]:
    """Gauges of a log state."""
    return {
        "pending_messages": state.ready_seq - state.delivered_seq,
        "staged_messages": state.next_seq - state.ready_seq,
        "delivered_seq": state.delivered_seq,
        "log_bytes": sum(f[3] for f in state.folders),
    }


class Progress(StreamingQueryListener):
    """Keeps the latest figures of each query."""

    def __init__(self):
        self.latest: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.latest[str(p.id)] = {"batch": p.batchId, "input_rows": p.numInputRows, "input_rows_per_second": p.inputRowsPerSecond or 0.0}

    def onQueryTerminated(self, event):
        self.latest.pop(str(event.id), None)
