"""Queries for the order-dependent checks, as batch jobs and as streams."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from ..operators import attempts as limits
from ..session import HOT_GROUP_ROWS_CONF, shared_dir
from ..streaming import jobs
from .base import Tables, query
from .work import RUN_SQL, run_events


class Streams(Tables):
    """The same tables as file streams."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return jobs.file_stream(self.spark, self.folder, f"{name}.parquet", schema)


def _streams(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


def _polls(t: Tables):
    """Documents of a source are its polls; every 13th failed."""
    k = F.col("doc_id")
    return t.documents.select(
        F.col("source").alias("source_id"), k.alias("poll_id"), (F.floor(k / 4) * 4).cast("long").alias("fetched_us"),
        F.sha2(F.when(k % 2 == 0, "same").otherwise(F.col("lang")), 256).alias("content_hash"), (k % 13 != 0).alias("ok"),
    )


_GATE = """WITH p AS (SELECT source, doc_id, doc_id // 4 AS pt, sha256(CASE WHEN doc_id % 2 = 0 THEN 'same' ELSE lang END) AS h FROM documents),
g AS (SELECT *, lag(h) OVER (PARTITION BY source ORDER BY pt, doc_id) AS prev FROM p WHERE doc_id % 13 <> 0)
SELECT source AS source_id, doc_id AS poll_id, CASE WHEN prev IS NULL OR prev <> h THEN 'changed' ELSE 'unchanged' END AS outcome FROM g
UNION ALL SELECT source, doc_id, 'error' FROM p WHERE doc_id % 13 = 0"""


@query("w02_t01_change_gate", _GATE)
def change_gate(t: Tables):
    return limits.change_gate(_polls(t), "source_id", ["fetched_us", "poll_id"]).select("source_id", "poll_id", "outcome")


@query("t01_change_gate_stream", _GATE)
def change_gate_stream(t: Tables):
    return t.spark.read.parquet(jobs.drain(jobs.change_gate(_polls(_streams(t)))))


# Event time runs 600 times as fast, so that windows hold many events.
def _attempts(t: Tables):
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long")
    return t.events.select(
        F.col("event_id").alias("attempt_id"), (F.col("user_id") % 5).alias("ip"),
        F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" User"), (F.col("user_id") % 10).cast("string"))).alias("identifier"),
        F.timestamp_micros(us).alias("ts"), us.alias("ts_us"),
    )


_LIMITS = """WITH RECURSIVE e AS (SELECT event_id, user_id % 5 AS ip, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'user' || (user_id % 10) END AS ident, epoch_us(ts) // 600 AS ts FROM events),
a AS (SELECT ip, min(ts) AS s FROM e GROUP BY ip UNION ALL SELECT a.ip, min(e.ts) FROM a JOIN e ON e.ip = a.ip AND e.ts >= a.s + 60000000 GROUP BY a.ip, a.s),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.ip, a.s ORDER BY e.ts, event_id) <= 10 AS ip_ok FROM e JOIN a ON a.ip = e.ip AND e.ts >= a.s AND e.ts < a.s + 60000000),
k AS (SELECT * FROM r WHERE ip_ok AND ident <> ''),
b AS (SELECT ident, min(ts) AS s FROM k GROUP BY ident UNION ALL SELECT b.ident, min(k.ts) FROM b JOIN k ON k.ident = b.ident AND k.ts >= b.s + 60000000 GROUP BY b.ident, b.s),
i AS (SELECT k.event_id, row_number() OVER (PARTITION BY k.ident, b.s ORDER BY k.ts, event_id) <= 5 AS id_ok FROM k JOIN b ON b.ident = k.ident AND k.ts >= b.s AND k.ts < b.s + 60000000)
SELECT r.event_id AS attempt_id, ip_ok, ip_ok AND coalesce(id_ok, true) AS allowed FROM r LEFT JOIN i ON i.event_id = r.event_id"""


@query("t02_login_limits", _LIMITS)
def login_limits(t: Tables):
    return limits.limit_logins(_attempts(t)).select("attempt_id", "ip_ok", "allowed")


@query("t02_login_limits_stream", _LIMITS)
def login_limits_stream(t: Tables):
    out = t.spark.read.parquet(jobs.drain(jobs.limit_logins(_attempts(_streams(t)))))
    return out.select("attempt_id", "ip_ok", "allowed")


_REFRESH = """WITH RECURSIVE e AS (SELECT event_id, user_id % 5 AS ip, epoch_us(ts) // 600 AS ts FROM events),
a AS (SELECT ip, min(ts) AS s FROM e GROUP BY ip UNION ALL SELECT a.ip, min(e.ts) FROM a JOIN e ON e.ip = a.ip AND e.ts >= a.s + 60000000 GROUP BY a.ip, a.s)
SELECT event_id AS attempt_id, row_number() OVER (PARTITION BY e.ip, a.s ORDER BY e.ts, event_id) <= 20 AS allowed
FROM e JOIN a ON a.ip = e.ip AND e.ts >= a.s AND e.ts < a.s + 60000000"""


@query("t02_refresh_limits", _REFRESH)
def refresh_limits(t: Tables):
    return limits.limit_refreshes(_attempts(t)).select("attempt_id", "allowed")


@query("t02_refresh_limits_stream", _REFRESH)
def refresh_limits_stream(t: Tables):
    return t.spark.read.parquet(jobs.drain(jobs.limit_refreshes(_attempts(_streams(t))))).select("attempt_id", "allowed")


@query("t02_refresh_limits_in_order", _REFRESH)
def refresh_limits_in_order(t: Tables):
    """Rows wait for the watermark; a row ten days after the last one lets all of them through."""
    rows = _attempts(t)
    ten = 10 * 86_400_000_000
    beat = rows.agg(F.max("ts_us").alias("last")).select(
        F.lit(-1).cast("long").alias("attempt_id"), F.lit(-1).cast(rows.schema["ip"].dataType).alias("ip"), F.lit(" ").alias("identifier"),
        F.timestamp_micros(F.col("last") + ten).alias("ts"), (F.col("last") + ten).alias("ts_us"),
    )
    folder = f"{shared_dir(t.spark).rstrip('/')}/beat-{uuid.uuid4()}"
    beat.write.parquet(folder)
    stream = _attempts(_streams(t)).unionByName(jobs.file_stream(t.spark, folder, "*.parquet", beat.schema))
    out = t.spark.read.parquet(jobs.drain(jobs.limit_refreshes(stream, "1 day")))
    return out.filter("attempt_id >= 0 AND NOT late").select("attempt_id", "allowed")


@contextmanager
def _all_hot(t: Tables, rows: int):
    """Every key with more rows than this takes the path of groups too large for a task."""
    conf, name = t.spark.conf, HOT_GROUP_ROWS_CONF
    before = conf.get(name, None)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before) if before else conf.unset(name)


@query("t02_hot_refresh_limits", _REFRESH.replace("user_id % 5", "coalesce(nullif(user_id % 5, 2), -1)"))
def hot_refresh_limits(t: Tables):
    """One of the addresses is null."""
    attempts = _attempts(t).withColumn("ip", F.nullif(F.col("ip"), F.lit(2)))
    with _all_hot(t, 100):
        return limits.limit_refreshes(attempts).select("attempt_id", "allowed")


# Every second event starts a job; most jobs end up to 50 minutes later.
def _job_events(t: Tables):
    e = F.col("event_id")
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10).cast("long")
    length = (e % 50) * 60_000_000
    base = t.events.filter(e % 2 == 0).select(
        F.col("event_type").alias("job_type"), (F.col("user_id") % 2).alias("entity_id"), e.alias("token"),
        F.explode(F.array(
            F.struct(F.lit("start").alias("kind"), us.alias("ts_us")),
            F.when(e % 7 != 0, F.struct(F.lit("end").alias("kind"), (us + length).alias("ts_us"))),
        )).alias("x"),
    )
    rows = base.filter(F.col("x").isNotNull()).select("job_type", "entity_id", "token", "x.*")
    return rows.withColumn("ts", F.timestamp_micros("ts_us"))


_HOLDS = """WITH RECURSIVE s AS (SELECT event_type AS job_type, user_id % 2 AS entity_id, event_id AS token, epoch_us(ts) // 10 AS ts,
  epoch_us(ts) // 10 + CASE WHEN event_id % 7 <> 0 AND event_id % 50 BETWEEN 1 AND 29 THEN (event_id % 50) * 60000000 ELSE 1800000000 END AS release FROM events WHERE event_id % 2 = 0),
a AS (SELECT job_type, entity_id, min((ts, token)) AS hd FROM s GROUP BY 1, 2
  UNION ALL SELECT a.job_type, a.entity_id, min((n.ts, n.token)) FROM a JOIN s ON s.token = a.hd[2] JOIN s n ON n.job_type = a.job_type AND n.entity_id = a.entity_id AND n.ts >= s.release AND n.token <> s.token GROUP BY a.job_type, a.entity_id, a.hd)
SELECT job_type, entity_id, token, token IN (SELECT hd[2] FROM a) AS accepted FROM s"""


@query("t03_one_at_a_time", _HOLDS)
def one_at_a_time(t: Tables):
    return limits.one_at_a_time(_job_events(t), ["job_type", "entity_id"]).select("job_type", "entity_id", "token", "accepted")


@query("t03_hot_holds", _HOLDS)
def hot_holds(t: Tables):
    with _all_hot(t, 50):
        return limits.one_at_a_time(_job_events(t), ["job_type", "entity_id"]).select("job_type", "entity_id", "token", "accepted")


@query("t03_one_at_a_time_stream", _HOLDS)
def one_at_a_time_stream(t: Tables):
    stream = jobs.one_at_a_time(_job_events(_streams(t)), ["job_type", "entity_id"])
    return t.spark.read.parquet(jobs.drain(stream)).select("job_type", "entity_id", "token", "accepted")


@query("t04_run_lifecycle_stream", RUN_SQL)
def run_lifecycle_stream(t: Tables):
    return jobs.drain_run_lifecycle(run_events(_streams(t))).select(
        "run_id", "status", F.coalesce("duration_ms", F.lit(-1.0)).alias("duration_ms"), F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("error_shown", F.lit("")).alias("error_shown"),
    )
