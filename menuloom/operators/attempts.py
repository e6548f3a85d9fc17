"""Batch forms of the order-dependent checks: change gate, attempt limits,
one job at a time. Each gives the rows its streaming form gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip_space
from .groups import hold_chain, previous_value

# Limits per window, seconds.
WINDOW_SECONDS = 60
LOGIN_PER_IP = 10
LOGIN_PER_IDENTIFIER = 5
REFRESH_PER_IP = 20
HOLD_SECONDS = 30 * 60


def normal_identifier(c: Column) -> Column:
    return F.lower(strip_space(F.coalesce(c, F.lit(""))))


def change_gate(polls: DataFrame, source: str, order: Sequence[str], content_hash: str = "content_hash", ok: str = "ok") -> DataFrame:
    """changed / unchanged / error for every poll. The first good poll of a source
    is a change; a failed one neither shows a change nor moves the hash."""
    good = polls.filter(F.col(ok))
    seen = previous_value(good, [source], order, content_hash, "previous_hash")
    judged = seen.withColumn(
        "outcome",
        F.when(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col(content_hash)), "changed").otherwise("unchanged"),
    )
    failed = polls.filter(~F.col(ok)).withColumn("previous_hash", F.lit(None).cast("string")).withColumn("outcome", F.lit("error"))
    return judged.unionByName(failed)


def limit_attempts(
    attempts: DataFrame, key: str, ts_us: str, attempt: str, limit: int, out: str, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Whether each attempt is within ``limit`` per window. A window opens at the
    key's first attempt outside any window, and refused attempts still count."""
    timed = attempts.withColumn("_release", F.col(ts_us) + F.lit(window_seconds * 1_000_000))
    held = hold_chain(timed, [key], [ts_us, attempt], ts_us, "_release")
    return held.withColumn(out, F.col("rank") <= limit).drop("_release", "is_holder", "rank", "holder_ts")


def limit_logins(attempts: DataFrame, ip: str = "ip", identifier: str = "identifier", ts_us: str = "ts_us", attempt: str = "attempt_id") -> DataFrame:
    """The address is checked first; the identifier counts only attempts that
    passed, and only when there is one."""
    by_ip = limit_attempts(attempts.withColumn(identifier, normal_identifier(F.col(identifier))), ip, ts_us, attempt, LOGIN_PER_IP, "ip_ok")
    counted = F.col("ip_ok") & (F.col(identifier) != "")
    by_id = limit_attempts(by_ip.filter(counted), identifier, ts_us, attempt, LOGIN_PER_IDENTIFIER, "id_ok")
    rest = by_ip.filter(~counted).withColumn("id_ok", F.lit(True))
    return by_id.unionByName(rest).withColumn("allowed", F.col("ip_ok") & F.col("id_ok"))


def limit_refreshes(attempts: DataFrame, ip: str = "ip", ts_us: str = "ts_us", attempt: str = "attempt_id") -> DataFrame:
    return limit_attempts(attempts, ip, ts_us, attempt, REFRESH_PER_IP, "allowed")


def one_at_a_time(
    events: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", token: str = "token", kind: str = "kind", hold_seconds: int = HOLD_SECONDS
) -> DataFrame:
    """Whether each start is accepted. A hold ends when its own token ends or
    after ``hold_seconds``; another token's end never releases it."""
    ends = events.filter(F.col(kind) == "end").groupBy(*keys, token).agg(F.min(ts_us).alias("_end"))
    starts = events.filter(F.col(kind) == "start").join(ends, [*keys, token], "left")
    expiry = F.col(ts_us) + F.lit(hold_seconds * 1_000_000)
    timed = starts.withColumn(
        "_release", F.least(expiry, F.when(F.col("_end") > F.col(ts_us), F.col("_end")))
    ).select(*keys, ts_us, token, "_release")
    held = hold_chain(timed, list(keys), [ts_us, token], ts_us, "_release")
    return held.withColumnRenamed("is_holder", "accepted").drop("_release", "rank", "holder_ts")
