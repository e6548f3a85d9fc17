"""Stateful streaming forms of the change gate, attempt limits, one-at-a-time
holds and run lifecycle.

By arrival (the default): state is two numbers per key, kept in RocksDB, without watermark or
timer; a row that comes late is judged against the state it meets.

In event order (``late_after``): rows wait in a buffer of their key until the watermark has passed
them, so that their verdicts are those of the batch form, whatever the order of arrival.
A row behind the watermark comes out at once, marked late and without a verdict. State
that can change no verdict any more is removed by a timer. No row is dropped either way.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import attempts as limits
from ..operators.runs import run_lifecycle
from ..session import shared_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND_US = 1_000_000


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# Files of one micro-batch: a backlog is worked off in batches of bounded size.
FILES_PER_BATCH = 100


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``name`` (a pattern) in ``folder``: single files or folders of files."""
    # As a glob the path may name a file, which as a plain path it may not.
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}}}")


def drain(stream: DataFrame, mode: str = "append", target: str | None = None, timeout: int | None = None, progress: list | None = None) -> str:
    """Process everything available into a parquet folder and return its path. The
    folder and the query's own checkpoint are under ``target``, by default in the shared
    folder; a target that was drained before goes on where it stopped. Updated rows carry
    the number of the micro-batch that wrote them. ``timeout`` in seconds; none by default.
    ``progress`` receives what the query tells of its last micro-batches."""
    root = (target or f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4()}").rstrip("/")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{root}/out")
    else:
        # A repeated micro-batch overwrites its own folder, so nothing is doubled.
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).start()
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream did not finish within {timeout} s")
        if progress is not None:
            progress += query.recentProgress
    finally:
        query.stop()
    return f"{root}/out"


def _sorted_rows(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The key's rows of one micro-batch in event order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


# Waiting rows are kept in sorted runs. A run is made of rows held at once, in pages that are read one at
# a time; this many runs are merged at once, so a task never holds more than a page of each.
RUN_ROWS, PAGE_ROWS, RUNS_MERGED = 50_000, 500, 100
# Rows of one frame that an ordered stream gives.
FRAME_ROWS = 10_000


def _batches(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    rest = iter(rows)
    while batch := list(islice(rest, size)):
        yield batch


class InOrder(StatefulProcessor):
    """Rows of a key in event order. ``fold`` has ``schema`` (of its state), ``columns`` (what it adds),
    ``row(state, row)`` giving the new state and the added values (None: no output row), and
    ``expiry(state)``, the microsecond from which the state is as good as none (None: never).

    Rows wait in sorted runs of pages. A timer merges the runs and reads their pages as it goes, so
    what it holds is bounded however many rows of the key the watermark has passed."""

    def __init__(self, fold, kinds: T.StructType, key: list[str], order: list[str], late: tuple, sizes: tuple | None = None) -> None:
        self._fold, self._kinds, self._key, self._order, self._late = fold, kinds, key, order, late
        self._names = kinds.fieldNames()
        self._at = [self._names.index(c) for c in order]
        self._run_rows, self._page_rows, self._merged, self._frame_rows = sizes or (RUN_ROWS, PAGE_ROWS, RUNS_MERGED, FRAME_ROWS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # The key of a page tells its first instant, so pages that must wait are not read.
        self._waiting = handle.getMapState("waiting", "run long, page long, from_us long", "rows binary")
        self._state = handle.getValueState("state", self._fold.schema)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [*self._names, *self._fold.columns, "late"]
        made = pd.DataFrame(rows, columns=names, dtype=object)
        return made.assign(**{k: [v] * len(made) for k, v in zip(self._key, key, strict=True)})

    def _wake(self, us: int) -> None:
        self._handle.registerTimer(us // 1000 + 1)

    def _place(self, row: tuple) -> list:
        return [row[i] for i in self._at]

    def _runs(self) -> list[list[tuple]]:
        """The pages of every run, in order."""
        pages = sorted(tuple(page) for page in self._waiting.keys()) if self._waiting.exists() else []
        return [list(run) for _, run in groupby(pages, key=itemgetter(0))]

    def _store(self, run: int, page: int, rows: list[tuple]) -> None:
        self._waiting.updateValue((run, page, int(rows[0][self._at[0]])), (pickle.dumps(rows),))

    def _keep(self, run: int, rows: Iterable[tuple]) -> None:
        for page, part in enumerate(_batches(rows, self._page_rows)):
            self._store(run, page, part)

    def _take(self, pages: list[tuple], passed: float) -> Iterator[tuple]:
        """Rows of a run before ``passed``; they leave the state, the others stay."""
        for page in pages:
            if page[2] >= passed:
                return
            rows = pickle.loads(bytes(self._waiting.getValue(page)[0]))
            self._waiting.removeKey(page)
            ready = [r for r in rows if r[self._at[0]] < passed]
            if len(ready) < len(rows):
                self._store(page[0], page[1], rows[len(ready):])
            yield from ready

    def _merge(self, runs: list[list[tuple]], passed: float) -> Iterator[tuple]:
        return heapq.merge(*[self._take(run, passed) for run in runs], key=self._place)

    def _passed_rows(self, passed: int) -> Iterator[tuple]:
        """All rows before the watermark in event order."""
        runs = self._runs()
        number = 1 + max((run[0][0] for run in runs), default=0)
        due = sorted((run for run in runs if run[0][2] < passed), key=len)
        while len(due) > self._merged:
            self._keep(number, self._merge(due[:self._merged], math.inf))
            number += 1
            due = sorted((run for run in self._runs() if run[0][2] < passed), key=len)
        return self._merge(due, passed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, fresh, first = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        number = 1 + max((run[0][0] for run in self._runs()), default=0)
        for pdf in rows:
            late = []
            for row in pdf[self._names].astype(object).where(pdf[self._names].notna(), None).itertuples(index=False, name=None):
                (late if row[self._at[0]] < passed else fresh).append(row)
            if len(fresh) >= self._run_rows:
                first = self._new_run(number, fresh, first)
                number, fresh = number + 1, []
            if late:
                yield self._frame(key, [(*r, *self._late, True) for r in late])
        if fresh:
            first = self._new_run(number, fresh, first)
        if first is not None:
            self._wake(first)

    def _new_run(self, number: int, rows: list[tuple], first: int | None) -> int:
        """Store the rows as a run; gives the first instant of these and earlier ones."""
        rows.sort(key=self._place)
        self._keep(number, rows)
        least = rows[0][self._at[0]]
        return least if first is None else min(first, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state = self._state.get() if self._state.exists() else None
        out = []
        for row in self._passed_rows(passed):
            state, told = self._fold.row(state, dict(zip(self._names, row, strict=True)))
            if told is not None:
                out.append((*row, *told, False))
            if len(out) >= self._frame_rows:
                yield self._frame(key, out)
                out = []
        until = None if state is None else self._fold.expiry(state)
        # What is waiting is at or behind the watermark, so a state that ends before it changes nothing.
        if state is None or until is not None and until <= passed:
            self._state.clear()
        else:
            self._state.update(tuple(state))
        rest = [run[0][2] for run in self._runs()]
        if rest:
            self._wake(min(rest))
        elif state is not None and until is not None and until > passed:
            self._wake(until)
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, keys: list[str], order: list[str], fold, added: list[T.StructField], late_after: str, late: tuple) -> DataFrame:
    """``events`` have ``ts`` for the watermark; ``order`` starts with a column of microseconds."""
    # The operator must not see the watermark's own column: it would drop late rows.
    rows = events.withWatermark("ts", late_after).drop("ts")
    kinds = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    schema = T.StructType([*kinds.fields, *added, T.StructField("late", T.BooleanType()), *[rows.schema[k] for k in keys]])
    processor = InOrder(fold, kinds, keys, order, late)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class GateFold:
    """The change gate; the last hash never expires."""

    schema, columns = "content_hash string", ("outcome",)

    def row(self, state, row: dict):
        if not row["ok"]:
            return state, ("error",)
        digest = row["content_hash"]
        return (digest,), ("changed" if state is None or state[0] is None or state[0] != digest else "unchanged",)

    def expiry(self, state) -> int | None:
        return None


class AttemptFold:
    """Attempts of the open window; it ends by itself."""

    schema = "start_us long, count long"

    def __init__(self, limit: int, flag: str, window_seconds: int) -> None:
        self._limit, self._window, self.columns = limit, window_seconds * SECOND_US, (flag,)

    def row(self, state, row: dict):
        start, count = state or (None, 0)
        if start is None or row["ts_us"] >= start + self._window:
            start, count = int(row["ts_us"]), 0
        return (start, count + 1), (count < self._limit,)

    def expiry(self, state) -> int | None:
        return state[0] + self._window


class HoldFold:
    """The hold in force; it ends with its token's end or by itself."""

    schema, columns = "token long, until_us long", ("accepted",)

    def __init__(self, hold_seconds: int) -> None:
        self._hold = hold_seconds * SECOND_US

    def row(self, state, row: dict):
        if row["kind"] == "end":
            return (None if state and state[0] == row["token"] else state), None
        free = state is None or row["ts_us"] >= state[1]
        return ((int(row["token"]), int(row["ts_us"]) + self._hold) if free else state), (free,)

    def expiry(self, state) -> int | None:
        return state[1]


class ChangeGate(StatefulProcessor):
    """State: the hash of the last good poll."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polls = _sorted_rows(rows, ["fetched_us", "poll_id"])
        last = self._last.get()[0] if self._last.exists() else None
        outcomes = []
        for digest, ok in zip(polls["content_hash"], polls["ok"]):
            if not ok:
                outcomes.append("error")
                continue
            outcomes.append("changed" if last is None or last != digest else "unchanged")
            last = digest
        if last is not None:
            self._last.update((last,))
        yield pd.DataFrame({"source_id": key[0], "poll_id": polls["poll_id"], "outcome": outcomes})

    def close(self) -> None:
        pass


def change_gate(polls: DataFrame, late_after: str | None = None) -> DataFrame:
    """Polls (source_id, poll_id, fetched_us, content_hash, ok) to outcomes; in event order
    (and with ``ts``) a late poll has the outcome ``late``."""
    prepare(polls.sparkSession)
    if late_after is not None:
        return _in_order(polls, ["source_id"], ["fetched_us", "poll_id"], GateFold(), [T.StructField("outcome", T.StringType())], late_after, ("late",))
    return polls.groupBy("source_id").transformWithStateInPandas(
        ChangeGate(), f"source_id {dict(polls.dtypes)['source_id']}, poll_id {dict(polls.dtypes)['poll_id']}, outcome string", "Append", "None"
    )


class AttemptLimit(StatefulProcessor):
    """State: start and count of the key's open window."""

    def __init__(self, limit: int, flag: str, window_seconds: int, active: str | None) -> None:
        self._limit, self._flag, self._active = limit, flag, active
        self._window = window_seconds * SECOND_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "start_us long, count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts = _sorted_rows(rows, ["ts_us", "attempt_id"])
        start, count = self._open.get() if self._open.exists() else (None, 0)
        counts = attempts[self._active] if self._active else [True] * len(attempts)
        flags = []
        for ts, counted in zip(attempts["ts_us"], counts):
            if not counted:
                flags.append(True)
                continue
            if start is None or ts >= start + self._window:
                start, count = int(ts), 0
            count += 1
            flags.append(count <= self._limit)
        if start is not None:
            self._open.update((start, count))
        yield attempts.assign(**{self._flag: flags})

    def close(self) -> None:
        pass


def _limited(attempts: DataFrame, key: str, limit: int, flag: str, window_seconds: int, active: str | None) -> DataFrame:
    schema = T.StructType([*attempts.schema.fields, T.StructField(flag, T.BooleanType())])
    return attempts.groupBy(key).transformWithStateInPandas(
        AttemptLimit(limit, flag, window_seconds, active), schema, "Append", "None"
    )


def limit_logins(attempts: DataFrame) -> DataFrame:
    """Attempts (attempt_id, ip, identifier, ts, ts_us), address first, then
    identifier: two stateful steps in one query. Attempts that the second step need not
    count (refused by address, or without an identifier) are spread over keys of
    their own, which hold no state."""
    prepare(attempts.sparkSession)
    rows = attempts.withColumn("identifier", limits.normal_identifier(F.col("identifier")))
    by_ip = _limited(rows, "ip", limits.LOGIN_PER_IP, "ip_ok", limits.WINDOW_SECONDS, None)
    counted = by_ip.withColumn("counted", F.col("ip_ok") & (F.col("identifier") != ""))
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("attempt_id"), F.lit(4096)).cast("string"))
    routed = counted.withColumn("route", F.when(F.col("counted"), F.concat(F.lit("+"), "identifier")).otherwise(spread))
    by_id = _limited(routed, "route", limits.LOGIN_PER_IDENTIFIER, "id_ok", limits.WINDOW_SECONDS, "counted")
    return by_id.drop("counted", "route").withColumn("allowed", F.col("ip_ok") & F.col("id_ok"))


def limit_refreshes(attempts: DataFrame, late_after: str | None = None) -> DataFrame:
    """Attempts (attempt_id, ip, ts, ts_us) with ``allowed``; null for late ones in event order."""
    prepare(attempts.sparkSession)
    if late_after is not None:
        fold = AttemptFold(limits.REFRESH_PER_IP, "allowed", limits.WINDOW_SECONDS)
        return _in_order(attempts, ["ip"], ["ts_us", "attempt_id"], fold, [T.StructField("allowed", T.BooleanType())], late_after, (None,))
    return _limited(attempts, "ip", limits.REFRESH_PER_IP, "allowed", limits.WINDOW_SECONDS, None)


class OneAtATime(StatefulProcessor):
    """State: token and expiry of the hold in force."""

    def __init__(self, keys: list[str], hold_seconds: int) -> None:
        self._keys, self._hold = keys, hold_seconds * SECOND_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "token long, until_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # At one instant an end comes before a start ("end" < "start").
        events = _sorted_rows(rows, ["ts_us", "kind", "token"])
        token, until = self._held.get() if self._held.exists() else (None, None)
        starts, accepted = [], []
        for ts, kind, owner in zip(events["ts_us"], events["kind"], events["token"]):
            if kind == "end":
                if token == owner:
                    token, until = None, None
                continue
            free = token is None or ts >= until
            if free:
                token, until = int(owner), int(ts) + self._hold
            starts.append((int(ts), int(owner)))
            accepted.append(free)
        if token is None:
            self._held.clear()
        else:
            self._held.update((token, until))
        yield pd.DataFrame(
            {**{k: [v] * len(starts) for k, v in zip(self._keys, key)}, "ts_us": [s[0] for s in starts],
             "token": [s[1] for s in starts], "accepted": accepted}
        )

    def close(self) -> None:
        pass


def one_at_a_time(events: DataFrame, keys: list[str], hold_seconds: int = limits.HOLD_SECONDS, late_after: str | None = None) -> DataFrame:
    """Job events (keys, token, kind, ts, ts_us) to accepted and refused starts. In event
    order late events of both kinds come out too, with a null verdict."""
    prepare(events.sparkSession)
    if late_after is not None:
        return _in_order(events, keys, ["ts_us", "kind", "token"], HoldFold(hold_seconds), [T.StructField("accepted", T.BooleanType())], late_after, (None,))
    fields = [events.schema[k] for k in keys]
    schema = T.StructType(
        [*fields, T.StructField("ts_us", T.LongType()), T.StructField("token", T.LongType()), T.StructField("accepted", T.BooleanType())]
    )
    return events.groupBy(*keys).transformWithStateInPandas(
        OneAtATime(keys, hold_seconds), schema, "Append", "None"
    )


def drain_run_lifecycle(events: DataFrame) -> DataFrame:
    """Run rows kept current by a streaming aggregation; each micro-batch adds the
    rows it changed and the newest row of a run is its state."""
    prepare(events.sparkSession)
    path = drain(run_lifecycle(events), "update")
    rows = events.sparkSession.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("run_id", "batch")]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select("run_id", "_r.*")
