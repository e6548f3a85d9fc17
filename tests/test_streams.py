"""Streaming forms over several micro-batches against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from menuloom.operators import attempts, runs
from menuloom.streaming import jobs


def stream(spark, tmp_path, df, files):
    """The rows as a stream of several files, in event order, one per batch."""
    columns = df.columns
    ordered = df.orderBy("ts").collect() if "ts" in columns else df.collect()
    size = -(-len(ordered) // files)
    for n in range(files):
        part = spark.createDataFrame(ordered[n * size:(n + 1) * size], df.schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"{n:03d}"))
    return jobs.file_stream(spark, str(tmp_path / "*"), "*.parquet", df.schema, files_per_batch=1)


def same(a, b, *columns):
    left, right = (sorted(map(tuple, d.select(*columns).collect())) for d in (a, b))
    assert left == right and left


def test_change_gate(spark, tmp_path):
    polls = spark.createDataFrame(
        [(s, i, i, random.Random(i).choice("ab"), i % 5 != 0) for i, s in enumerate("xyx" * 20)],
        "source_id string, poll_id long, fetched_us long, content_hash string, ok boolean",
    )
    twin = attempts.change_gate(polls, "source_id", ["fetched_us", "poll_id"])
    out = spark.read.parquet(jobs.drain(jobs.change_gate(stream(spark, tmp_path, polls, 3)), timeout=120))
    same(out, twin, "source_id", "poll_id", "outcome")


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_in_one_file_or_a_folder(spark, tmp_path, files):
    rows = spark.range(12).withColumn("v", F.col("id") * 2)
    rows.repartition(files).write.parquet(str(tmp_path / "made"))
    if files == 1:
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "t.parquet")
    else:
        (tmp_path / "made").rename(tmp_path / "t.parquet")
    spark.range(5).withColumn("v", F.lit(-1).cast("long")).write.parquet(str(tmp_path / "other.parquet"))
    got = spark.read.parquet(jobs.drain(jobs.file_stream(spark, str(tmp_path), "t.parquet", rows.schema, files_per_batch=2), timeout=120))
    same(got, rows, "id", "v")


@pytest.fixture
def login_attempts(spark):
    rng = random.Random(3)
    data, ts = [], 0
    for i in range(400):
        ts += rng.choice([0, 1, 1, 2, 30]) * 1_000_000
        data.append((i, f"ip{rng.randrange(2)}", rng.choice([" Ann", "ann ", "bob", " "]), ts))
    return spark.createDataFrame(data, "attempt_id long, ip string, identifier string, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))


def test_login_limits(spark, tmp_path, login_attempts, hot_groups):
    twin = attempts.limit_logins(login_attempts)
    out = spark.read.parquet(jobs.drain(jobs.limit_logins(stream(spark, tmp_path, login_attempts, 3)), timeout=240))
    same(out, twin, "attempt_id", "ip_ok", "allowed")
    assert twin.filter("ip_ok and not allowed").count() and twin.filter("not ip_ok").count()


def test_login_limits_one_by_one(login_attempts):
    """A counter per key that expires sixty seconds after its first event."""
    got = {r.attempt_id: (r.ip_ok, r.allowed) for r in attempts.limit_logins(login_attempts).collect()}
    windows = {}

    def count(key, ts):
        start, n = windows.get(key, (None, 0))
        if start is None or ts >= start + 60_000_000:
            start, n = ts, 0
        windows[key] = (start, n + 1)
        return n + 1

    for r in sorted(login_attempts.collect(), key=lambda r: (r.ts_us, r.attempt_id)):
        ip_ok = count(("ip", r.ip), r.ts_us) <= 10
        who = r.identifier.strip().lower()
        id_ok = count(("id", who), r.ts_us) <= 5 if ip_ok and who else True
        assert got[r.attempt_id] == (ip_ok, ip_ok and id_ok)


def test_refresh_limit(spark, tmp_path, login_attempts):
    twin = attempts.limit_attempts(login_attempts, "ip", "ts_us", "attempt_id", attempts.REFRESH_PER_IP, "allowed")
    out = spark.read.parquet(jobs.drain(jobs.limit_refreshes(stream(spark, tmp_path, login_attempts, 2)), timeout=120))
    same(out, twin, "attempt_id", "allowed")


def test_one_at_a_time(spark, tmp_path):
    rng = random.Random(5)
    data = []
    for token in range(120):
        ts = token * 240_000_000 + rng.randrange(100_000_000)
        key = ("crawl" if token % 3 else "review", f"e{token % 2}")
        data.append((*key, token, "start", ts))
        if token % 4:
            data.append((*key, token, "end", ts + rng.randrange(1, 3_000) * 1_000_000))
    events = spark.createDataFrame(data, "job_type string, entity_id string, token long, kind string, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
    twin = attempts.one_at_a_time(events, ["job_type", "entity_id"])
    out = spark.read.parquet(jobs.drain(jobs.one_at_a_time(stream(spark, tmp_path, events, 3), ["job_type", "entity_id"]), timeout=120))
    same(out, twin, "token", "accepted")
    assert twin.filter("accepted").count() and twin.filter("not accepted").count()


def test_run_lifecycle(spark, tmp_path):
    data = []
    for run in range(40):
        data.append((run, run * 10, "start", run * 1_000_000, None))
        if run % 3:
            data.append((run, run * 10 + 1, "failed" if run % 2 else "succeeded", run * 1_000_000 + 1_234_567, "x" * 3000))
    events = spark.createDataFrame(data, "run_id long, event_id long, kind string, us long, error string").withColumn("ts", F.timestamp_micros("us")).drop("us")
    twin = runs.run_lifecycle(events)
    out = jobs.drain_run_lifecycle(stream(spark, tmp_path, events, 3))
    same(out.na.fill(""), twin.na.fill(""), "run_id", "status", F.coalesce("duration_ms", F.lit(-1.0)), "error_message")
    assert tuple(twin.agg(F.max(F.length("error_message")), F.max(F.length("error_shown"))).first()) == (3000, 2000)


def test_late_attempts_get_a_verdict(spark, tmp_path):
    """An attempt hours older than what was seen before is judged, not dropped."""
    first = [(i, 1, "u", 7_200_000_000 + i) for i in range(12)]
    late = [(100, 1, "u", 5), (101, 2, None, 6)]
    for n, rows in enumerate((first, late)):
        df = spark.createDataFrame(rows, "attempt_id long, ip long, identifier string, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
        df.coalesce(1).write.parquet(str(tmp_path / f"{n}"))
    source = jobs.file_stream(spark, str(tmp_path / "*"), "*.parquet", df.schema, files_per_batch=1)
    out = spark.read.parquet(jobs.drain(jobs.limit_logins(source), target=str(tmp_path / "drained"), timeout=120))
    got = {r.attempt_id: r.allowed for r in out.collect()}
    assert set(got) == {*range(12), 100, 101}
    assert got[101] and [got[i] for i in range(12)] == [True] * 5 + [False] * 7


# --- event order ---------------------------------------------------------------

def shuffled_stream(spark, tmp_path, df, rng, files=6, beat=None):
    """The rows in any order over several files, then a row that moves the watermark past all."""
    rows = df.collect()
    rng.shuffle(rows)
    size = -(-len(rows) // files)
    parts = [rows[n * size:(n + 1) * size] for n in range(files)] + ([[beat]] if beat else [])
    for n, part in enumerate(parts):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"{n:03d}"))
    return jobs.file_stream(spark, str(tmp_path / "*"), "*.parquet", df.schema, files_per_batch=1)


def test_refreshes_in_any_order(spark, tmp_path, login_attempts):
    """Shuffled attempts get the verdicts of the batch form, and all state ends."""
    from datetime import datetime, timedelta

    twin = attempts.limit_refreshes(login_attempts)
    last = max(r.ts_us for r in login_attempts.collect()) + 10 * 86_400_000_000
    beat = (9999, "beat", None, last, datetime(1970, 1, 1) + timedelta(microseconds=last))
    source = shuffled_stream(spark, tmp_path, login_attempts, random.Random(8), beat=beat)
    told = []
    out = spark.read.parquet(jobs.drain(jobs.limit_refreshes(source, "1 day"), timeout=240, progress=told)).filter("ip <> 'beat'")
    assert out.filter("late").count() == 0
    same(out, twin, "attempt_id", "allowed")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in told if p["stateOperators"]]
    assert max(held) >= 3 and held[-1] == 1, held  # only the beat is left waiting


def test_late_rows_are_told(spark, tmp_path):
    """With a short wait some rows are late: each comes out once, and the others are judged without them."""
    rng = random.Random(9)
    polls = spark.createDataFrame([("s", i, i * 1_000_000, rng.choice("ab"), i % 5 != 0) for i in range(60)], "source_id string, poll_id long, fetched_us long, content_hash string, ok boolean")
    polls = polls.withColumn("ts", F.timestamp_micros("fetched_us"))
    beat = polls.orderBy(F.desc("fetched_us")).limit(1).withColumns({"source_id": F.lit("beat"), "ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "fetched_us": F.col("fetched_us") + 86_400_000_000}).first()
    source = shuffled_stream(spark, tmp_path, polls, rng, beat=beat)
    out = spark.read.parquet(jobs.drain(jobs.change_gate(source, "5 seconds"), timeout=240)).filter("source_id = 's'").collect()
    assert sorted(r.poll_id for r in out) == list(range(60))
    late = {r.poll_id for r in out if r.late}
    assert 0 < len(late) < 60 and all((r.outcome == "late") == r.late for r in out)
    twin = attempts.change_gate(polls.filter(~F.col("poll_id").isin(*late)), "source_id", ["fetched_us", "poll_id"])
    assert {(r.poll_id, r.outcome) for r in out if not r.late} == {(r.poll_id, r.outcome) for r in twin.collect()}


def test_holds_in_any_order(spark, tmp_path):
    rng = random.Random(10)
    data = []
    for token in range(150):
        ts = token * 200_000_000 + rng.randrange(100_000_000)
        data.append(("crawl", f"e{token % 3}", token, "start", ts))
        if token % 4:
            data.append(("crawl", f"e{token % 3}", token, "end", ts + rng.randrange(1, 3_000) * 1_000_000))
    events = spark.createDataFrame(data, "job_type string, entity_id string, token long, kind string, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
    twin = attempts.one_at_a_time(events, ["job_type", "entity_id"])
    beat = events.orderBy(F.desc("ts_us")).limit(1).withColumns({"job_type": F.lit("beat"), "ts": F.col("ts") + F.expr("INTERVAL 30 DAY"), "ts_us": F.col("ts_us") + 30 * 86_400_000_000}).first()
    source = shuffled_stream(spark, tmp_path, events, rng, beat=beat)
    out = spark.read.parquet(jobs.drain(jobs.one_at_a_time(source, ["job_type", "entity_id"], late_after="2 days"), timeout=240)).filter("job_type = 'crawl'")
    assert out.filter("late").count() == 0
    same(out, twin, "token", "accepted")


class HeldState:
    """State of one key without Spark; ``read`` are the rows that each read of a page gave."""

    def __init__(self):
        self.pages, self.value, self.timers, self.read = {}, None, [], []

    def getMapState(self, name, key, value):
        return MapOfPages(self)

    def getValueState(self, name, schema):
        return OneValue(self)

    def registerTimer(self, ms):
        self.timers.append(ms)


class MapOfPages:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return bool(self.held.pages)

    def keys(self):
        return iter(list(self.held.pages))

    def getValue(self, page):
        import pickle

        self.held.read.append(len(pickle.loads(self.held.pages[page][0])))
        return self.held.pages[page]

    def updateValue(self, page, value):
        self.held.pages[page] = value

    def removeKey(self, page):
        del self.held.pages[page]


class OneValue:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return self.held.value is not None

    def get(self):
        return self.held.value

    def update(self, value):
        self.held.value = value

    def clear(self):
        self.held.value = None


class Watermark:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_timer_holds_a_page_of_each_run():
    """However many rows wait, a timer reads them page by page and gives them in small frames."""
    import pandas as pd
    from pyspark.sql import types as T

    rng = random.Random(11)
    kinds = T.StructType([T.StructField("attempt_id", T.LongType()), T.StructField("ts_us", T.LongType())])
    ordered = sorted((rng.randrange(400) * 1_000_000, n) for n in range(600))
    given = [(n, ts) for ts, n in ordered]
    rng.shuffle(given)
    held = HeldState()
    job = jobs.InOrder(jobs.AttemptFold(3, "allowed", 60), kinds, ["ip"], ["ts_us", "attempt_id"], (None,), sizes=(20, 4, 3, 10))
    job.init(held)
    for at in range(0, 600, 60):
        batches = (pd.DataFrame(given[n:n + 30], columns=kinds.fieldNames()) for n in (at, at + 30))
        assert list(job.handleInputRows(("a",), batches, Watermark(0))) == []
    assert len(held.pages) >= 150
    told = []
    for passed in (150_500_000, 1_000_000_000):
        frames = list(job.handleExpiredTimer(("a",), Watermark(passed), None))
        assert max(len(f) for f in frames) <= 10
        told += [r for f in frames for r in zip(f["ts_us"], f["attempt_id"], f["allowed"])]
    assert max(held.read) <= 4 and not held.pages and held.value is None
    assert [(ts, n) for ts, n, _ in told] == ordered
    start, count = None, 0
    for ts, _, allowed in told:
        if start is None or ts >= start + 60_000_000:
            start, count = ts, 0
        count += 1
        assert allowed == (count <= 3)
