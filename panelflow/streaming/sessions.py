"""Streaming gap sessions (the §2.11 extension).

``session_window`` closes a person's session once the watermark passes the
last row plus the gap.  A gap of exactly ``gap_hours`` stays in the session
and a longer one opens a new session, like the batch rule.  The streaming
form yields per-session aggregates only (no lags).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessionize_stream(events: DataFrame, key: str, ts: str, gap_hours: float = 30.0, *,
                      watermark: str | None = None,
                      aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-(person, session) aggregates of a stream (or a batch frame).

    ``ts`` must be a timestamp column.  ``watermark`` defaults to the gap,
    so late rows up to one gap behind are still placed.
    """
    gap = f"{int(round(gap_hours * 3600))} seconds"
    d = events.withWatermark(ts, watermark or gap) if events.isStreaming else events
    extra = [e.alias(n) for n, e in (aggs or {}).items()]
    return (d.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("session_window"))
            .agg(F.count(F.lit(1)).alias("n_obs"), F.min(ts).alias("start"), F.max(ts).alias("end"), *extra))


def start_sessions_query(events: DataFrame, key: str, ts: str, gap_hours: float, *,
                         sink: str, path: str | None = None, checkpoint: str,
                         query_name: str | None = None, available_now: bool = False):
    """Run :func:`sessionize_stream` to a sink in append mode.

    ``checkpoint`` must be a shared folder on a cluster (the query state
    lives there, so a restarted driver resumes where it stopped).
    """
    out = sessionize_stream(events, key, ts, gap_hours)
    w = out.writeStream.outputMode("append").format(sink).option("checkpointLocation", checkpoint)
    if path:
        w = w.option("path", path)
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
