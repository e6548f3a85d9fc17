"""Work on groups of any size.

A window over a key puts the whole key into one task. Keys with more rows than
``spark.menuloom.hotGroupRows`` are therefore handled apart: their rows are
range-partitioned by (key, order), which gives even chunks whatever the key
sizes are, each chunk is worked on alone, and only one summary row per chunk is
combined in order. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import (
    CHUNK_ROWS_CONF, CHUNK_ROWS_DEFAULT, HOT_GROUP_ROWS_CONF, HOT_GROUP_ROWS_DEFAULT, broadcast_if_small, int_conf, reliable_checkpoint,
)

CHUNK = "chunk_no"
# Stands for no hold where a release is asked for.
_FREE = -(1 << 62)
# Stands for no time; such rows come last and take no hold that is not free.
_LEAST = -(1 << 63)


def hot_limit(df: DataFrame) -> int:
    return int_conf(df.sparkSession, HOT_GROUP_ROWS_CONF, HOT_GROUP_ROWS_DEFAULT)


def _chunk_rows(df: DataFrame) -> int:
    return max(int_conf(df.sparkSession, CHUNK_ROWS_CONF, CHUNK_ROWS_DEFAULT), 1)


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None when there are none).

    The count combines map-side. There are at most rows/limit hot keys, so the
    optimizer normally broadcasts them; nothing here forces it to."""
    hot_keys = (
        df.groupBy(*keys).count().filter(F.col("count") > hot_limit(df))
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    )
    if hot_keys.isEmpty():
        return df, None
    hot_keys = broadcast_if_small(hot_keys)
    matches = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(hot_keys, matches, "left_anti"), df.join(hot_keys, matches, "left_semi")


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a chunk number that grows with (keys, order). It is fixed in the
    shared folder before use, so a re-run task cannot number rows differently. The size
    of chunks is what a task handles well; it does not follow the limit for hot keys."""
    per_chunk = _chunk_rows(df)
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(shuffle, -(-df.count() // per_chunk), 2)
    ranged = df.repartitionByRange(int(wanted), *keys, *order)
    return reliable_checkpoint(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _dealt(df: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by chunk to as many tasks as ``chunks`` has, so that a task sorts a few of them whatever
    the number of shuffle partitions."""
    last = chunks.agg(F.max(CHUNK)).first()[0]
    return df.repartition((last or 0) + 1, *keys, CHUNK)


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    chunked: Callable[[DataFrame], DataFrame],
    largest: int | None = None,
) -> DataFrame:
    """``largest`` is the size of the largest group where the caller knows it, which saves counting."""
    if largest is not None and largest <= hot_limit(df):
        return plain(df)
    cold, hot = split_hot(df, keys)
    out = plain(cold)
    if hot is None:
        return out
    return out.unionByName(chunked(with_chunks(hot, keys, order)).drop(CHUNK))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key columns of both sides where a null key part equals a null one. Catalyst
    still sees an equality join. The keys come out once."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = left.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full_outer":
        joined = joined.withColumns({k: F.coalesce(k, f"_k_{k}") for k in keys})
    return joined.drop(*[f"_k_{k}" for k in keys])


def _join_back(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys and the chunk; a null key is a key like any other."""
    on = [*keys, CHUNK]
    facts = carried.withColumnsRenamed({k: f"_f_{k}" for k in on})
    return rows.join(facts, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in on], "left").drop(*[f"_f_{k}" for k in on])


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key, for groups of any size."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))

    def chunked(rows: DataFrame) -> DataFrame:
        local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
        last = rows.groupBy(*keys, CHUNK).agg(
            F.max_by(F.struct(value), F.struct(*order)).alias("_last")
        )
        carried = last.withColumn(
            "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK))
        ).drop("_last")
        numbered = _dealt(rows, rows, keys).withColumn("_rn", F.row_number().over(local)).withColumn("_lag", F.lag(value).over(local))
        return (
            _join_back(numbered, carried, keys)
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")[value]).otherwise(F.col("_lag")))
            .drop("_rn", "_lag", "_carry")
        )

    return by_group_size(df, keys, order, plain, chunked)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number`` per key, for groups of any size."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))

    def chunked(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        local = _dealt(rows, rows, keys).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
        return _join_back(local, carried, keys).withColumn(out, F.col("_before") + F.col("_rn")).drop("_before", "_rn")

    return by_group_size(df, keys, order, plain, chunked)


def totals_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, out: str, largest: int | None = None) -> DataFrame:
    """Sum of ``size`` over the earlier rows of a key, for groups of any size. ``order`` leaves only equal rows in a tie."""
    earlier = lambda by, at: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, earlier(keys, order))

    def chunked(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*keys, CHUNK).agg(F.sum(size).alias(size))
        carried = sums.withColumn("_before", earlier(keys, [CHUNK])).drop(size)
        local = _dealt(rows, rows, keys).withColumn("_own", earlier([*keys, CHUNK], order))
        return _join_back(local, carried, keys).withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own")

    return by_group_size(df, keys, order, plain, chunked, largest)


def _next_holder(ts: np.ndarray, release: np.ndarray) -> np.ndarray:
    """For each row the first later row at or after its release."""
    later = np.searchsorted(ts, release, side="left")
    return np.maximum(later, np.arange(len(ts)) + 1)


def _with_holds(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, release: str, entered: Sequence[str] = ()) -> DataFrame:
    """``is_holder``, ``rank`` and ``holder_ts`` of each row, in one pass over the sorted rows of
    each ``by``: Spark sorts, Python holds one batch. ``entered`` names the columns of the
    hold a group is entered with (its release, time and rank); they are dropped."""
    numbered = df.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])))
    kept = [c for c in df.columns if c not in entered]
    added = [T.StructField("is_holder", T.BooleanType()), T.StructField("rank", T.LongType()), T.StructField("holder_ts", T.LongType())]
    schema = T.StructType([*[df.schema[c] for c in kept], *added])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until, start, rank = None, None, 0
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()
            heads = list(zip(*map(column, entered), strict=True)) if entered else None
            holder, ranks, starts = [], [], []
            for i, (no, t, end) in enumerate(zip(column("_no"), column(ts), column(release), strict=True)):
                if no == 1:
                    until, start, rank = heads[i] if heads else (None, None, 0)
                t, end = _LEAST if t is None else t, _LEAST if end is None else end
                takes = until is None or t >= until
                if takes:
                    until, start, rank = end, t, 0
                rank += 1
                holder.append(takes)
                ranks.append(rank)
                starts.append(start)
            told = [pa.array(holder, pa.bool_()), pa.array(ranks, pa.int64()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *told], names=[f.name for f in schema.fields])

    return numbered.mapInArrow(mark, schema)


def hold_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, release: str) -> DataFrame:
    """Greedy holds: the first row of a key takes the hold until its
    ``release``; rows before that instant are under the hold, and the first row
    at or after it takes the next. Adds ``is_holder``, ``rank`` (place under the
    hold, holder = 1) and ``holder_ts``. ``ts`` and ``release`` are integers and
    ``order`` starts with ``ts``.

    A hot key is never one task's. Each chunk tells with which releases it may be left; these
    few (the holds in force at its end) are the ways in which later chunks may be entered. What
    follows from each way is worked out within its chunk, which gives pointers from release to
    release. Those that really happen start at the key's first row and are found by doubling
    the pointers, in as many rounds as the number of chunks has binary digits. Last, each chunk
    is marked with the hold it was really entered with. Marking never holds a group in Python."""
    order = list(order)
    def arrays(pdf: pd.DataFrame):
        return pdf[ts].to_numpy("int64"), pdf[release].to_numpy("int64")

    def plain(rows: DataFrame) -> DataFrame:
        return _with_holds(rows, keys, order, ts, release)

    def chunked(rows: DataFrame) -> DataFrame:
        keys_, limit = list(keys), _chunk_rows(df)
        place = [*[rows.schema[k] for k in keys_], T.StructField(CHUNK, T.IntegerType())]
        longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
        narrow = rows.select(*dict.fromkeys([*keys_, CHUNK, *order, ts, release]))

        def chains(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Times, releases, and for each row the last holder within the chunk if it takes the hold."""
            t, r = arrays(pdf.sort_values(order, kind="stable"))
            follow, last = _next_holder(t, r), np.arange(len(t))
            for i in range(len(t) - 1, -1, -1):
                if follow[i] < len(t):
                    last[i] = last[follow[i]]
            return t, r, last

        def ways_out(pdf: pd.DataFrame) -> pd.DataFrame:
            t, r, last = chains(pdf)
            out = np.unique(r[np.unique(last)])
            return pd.DataFrame({**{c: pdf[c].iloc[0] for c in [*keys_, CHUNK]}, "until": out, "last_ts": t[-1], "n": len(t)}, index=range(len(out)))

        left = reliable_checkpoint(narrow.groupBy(*keys_, CHUNK).applyInPandas(ways_out, T.StructType([*place, *longs("until", "last_ts", "n")])))
        by_chunk = Window.partitionBy(*keys_).orderBy(CHUNK)  # one row per chunk
        chunks = left.select(*keys_, CHUNK, "last_ts", "n").distinct().withColumn("_from", F.lag("last_ts").over(by_chunk)).withColumn(
            "_before", F.coalesce(F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        chunks = reliable_checkpoint(chunks)
        bounds = broadcast_if_small(chunks.filter("_from IS NOT NULL").select(*[F.col(k).alias(f"_b_{k}") for k in keys_], F.col(CHUNK).alias("_to"), "_from", F.col("last_ts").alias("_upto")))

        def entered(releases: DataFrame, until: str) -> DataFrame:
            """The chunk that holds the first row at or after a release; none at the key's end."""
            same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys_]
            return releases.join(bounds, [*same, F.col(until) > F.col("_from"), F.col(until) <= F.col("_upto")])

        # A key's first chunk is entered freely, which is no release at all.
        free = chunks.filter("_from IS NULL").select(*keys_, CHUNK, F.lit(_FREE).alias("until"))
        ways = entered(left.select(*keys_, "until").distinct(), "until").select(*keys_, F.col("_to").alias(CHUNK), "until").unionByName(free)
        parts = ways.groupBy(*keys_, CHUNK).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_parts"))
        dealt = join_keys(ways, parts, [*keys_, CHUNK]).withColumn("_part", F.pmod(F.xxhash64("until"), F.col("_parts")).cast("int"))
        dealt = dealt.drop("_parts")
        copies = join_keys(narrow, dealt.select(*keys_, CHUNK, "_part").distinct(), [*keys_, CHUNK])

        def ways_through(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            until = asked["until"].to_numpy("int64")
            t, r, last = chains(pdf)
            at = last[np.searchsorted(t, until, side="left")]
            return pd.DataFrame({**{c: asked[c].iloc[0] for c in [*keys_, CHUNK]}, "until": until, "leave": r[at], "leave_ts": t[at], "leave_pos": at}, index=range(len(until)))

        found = T.StructType([*place, *longs("until", "leave", "leave_ts", "leave_pos")])
        # Names of their own, as both sides come from one table.
        sides = [x.select(*[F.col(c).alias(c) for c in x.columns]).groupBy(*keys_, CHUNK, "_part") for x in (copies, dealt)]
        through = reliable_checkpoint(sides[0].cogroup(sides[1]).applyInPandas(ways_through, found))
        steps = reliable_checkpoint(entered(through.select(*keys_, "until", "leave"), "leave").select(*keys_, "until", F.col("leave").alias("_next")))
        real, known = free.select(*keys_, "until"), 0
        while (count := real.count()) > known:
            known = count
            further = join_keys(real, steps, [*keys_, "until"]).select(*keys_, F.col("_next").alias("until"))
            real = reliable_checkpoint(real.unionByName(further).distinct())
            twice = steps.select(*keys_, F.col("until").alias("_first"), F.col("_next").alias("until"))
            steps = reliable_checkpoint(join_keys(twice, steps, [*keys_, "until"]).select(*keys_, F.col("_first").alias("until"), "_next"))

        happened = join_keys(through, real, [*keys_, "until"], "left_semi").select(*keys_, CHUNK, "leave", "leave_ts", "leave_pos")
        held = join_keys(chunks, happened, [*keys_, CHUNK], "left").withColumn(
            "_hold", F.when(F.col("leave").isNotNull(), F.struct("leave", "leave_ts", (F.col("_before") + F.col("leave_pos")).alias("pos")))
        )
        carried = held.withColumn("_hold", F.last("_hold", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)))
        entries = carried.select(
            *keys_, CHUNK, F.col("_hold.leave").alias("busy_until"), F.col("_hold.leave_ts").alias("carried_ts"),
            F.coalesce(F.col("_before") - F.col("_hold.pos"), F.lit(0)).alias("carried_rank"),
        )

        hold = ["busy_until", "carried_ts", "carried_rank"]
        return _with_holds(_dealt(_join_back(rows, entries, keys), chunks, keys), [*keys, CHUNK], order, ts, release, hold)

    return by_group_size(df, keys, order, plain, chunked)


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, how: str = "inner") -> DataFrame:
    """Join rows with one fact row per key. ``size`` is the fact's row count.

    The facts of hot keys are few (at most rows/limit). Once counted to fit, they
    are broadcast and the rows of those keys stay where they are; all other keys
    are joined by a shuffle in which no key is large. Should they not fit, they
    are joined by a shuffle too, whose large partitions adaptive execution splits."""
    limit = hot_limit(rows)
    hot = facts.filter(F.col(size) > limit)
    if hot.isEmpty():
        return join_keys(rows, facts, keys, how)
    hot = broadcast_if_small(hot)
    on_hot = join_keys(rows, hot, keys)
    cold = join_keys(rows, hot.select(*keys), keys, "left_anti")
    rest = join_keys(cold, facts.filter(F.col(size) <= limit), keys, how)
    return on_hot.unionByName(rest)


def top_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each key. Spark limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends n rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, keys: Sequence[str], pos: str, flag: str) -> DataFrame:
    """Flag the first row of every key by position. The key's first position is
    a map-side minimum; it meets its row on (key, position), which is unique, so
    a key with many copies is spread over all tasks. Rows without a key form one
    group, as in a window."""
    on = [*keys, pos]
    firsts = df.groupBy(*keys).agg(F.min(pos).alias(pos)).withColumn(flag, F.lit(True)).withColumnsRenamed({k: f"_f_{k}" for k in on})
    joined = df.join(firsts, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in on], "left")
    return joined.drop(*[f"_f_{k}" for k in on]).withColumn(flag, F.coalesce(flag, F.lit(False)))
