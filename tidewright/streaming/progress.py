"""Progress streams: throttled events of a job, batch and streaming from the same rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

INTERVAL_MS = 100
SCHEMA = "job long, stage string, done long, total long, ts_ms long"


def emitted(rows: pd.DataFrame, last: tuple | None, interval: int = INTERVAL_MS) -> tuple[list[int], tuple | None]:
    """Positions that are sent: a new stage or total, completion, or ``interval`` since the last sent."""
    keep = []
    for i, (stage, done, total, ts) in enumerate(zip(rows["stage"], rows["done"], rows["total"], rows["ts_ms"], strict=True)):
        if last is None or last[0] != stage or last[1] != total or done == total or ts - last[2] >= interval:
            keep.append(i)
            last = (stage, int(total), int(ts))
    return keep, last


def throttle(events: DataFrame) -> DataFrame:
    """Batch: each job's events in order; a job is one group, as its rule refers to its own last event."""

    def one(rows):
        rows = rows.sort_values(["ts_ms", "done"], kind="stable")
        return rows.iloc[emitted(rows, None)[0]]

    return events.groupBy("job").applyInPandas(one, SCHEMA)


def throttle_stream(events: DataFrame) -> DataFrame:
    """R2: the same rule on a stream; a job's state is the last event that was sent."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def one(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for rows in parts:
            rows = rows.sort_values(["ts_ms", "done"], kind="stable")
            keep, last = emitted(rows, last)
            yield rows.iloc[keep]
        if last is not None:
            state.update(last)

    return events.groupBy("job").applyInPandasWithState(one, SCHEMA, "stage string, total long, ts_ms long", "append", GroupStateTimeout.NoTimeout)


def throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return throttle(events.selectExpr("user_id % 50 AS job", "CASE event_id div 500 % 3 WHEN 0 THEN 'images' WHEN 1 THEN 'streams' ELSE 'saving' END AS stage", "event_id % 11 AS done", "CAST(10 AS BIGINT) AS total", "event_id AS ts_ms"))


QUERIES = {"throttled_progress": throttled_progress}
ORACLE_SQL = {
    "throttled_progress": """
WITH RECURSIVE e AS (SELECT user_id % 50 AS job, list_extract(['images', 'streams', 'saving'], event_id // 500 % 3 + 1) AS stage, event_id % 11 AS done, CAST(10 AS BIGINT) AS total, event_id AS ts_ms, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events),
s(job, k, stage, done, total, ts_ms, sent, last_stage, last_ms) AS (
  SELECT job, k, stage, done, total, ts_ms, true, stage, ts_ms FROM e WHERE k = 1
  UNION ALL
  SELECT e.job, e.k, e.stage, e.done, e.total, e.ts_ms, e.stage <> s.last_stage OR e.done = e.total OR e.ts_ms - s.last_ms >= 100,
    CASE WHEN e.stage <> s.last_stage OR e.done = e.total OR e.ts_ms - s.last_ms >= 100 THEN e.stage ELSE s.last_stage END,
    CASE WHEN e.stage <> s.last_stage OR e.done = e.total OR e.ts_ms - s.last_ms >= 100 THEN e.ts_ms ELSE s.last_ms END
  FROM s JOIN e ON e.job = s.job AND e.k = s.k + 1)
SELECT job, stage, done, total, ts_ms FROM s WHERE sent"""
}
