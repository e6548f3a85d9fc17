"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(``SCALE`` * x), and a score is the integer inner product. Queries
are a stated set of rows; every other row of their length is a candidate. Blocks of queries meet
blocks of candidates, both bounded in rows and in values, and score all their pairs, but no score
leaves its block as such:

1. Each query has a range that holds its k-th highest score (at first by Cauchy and Schwarz). A
   block counts its scores in ``BINS`` equal bins of the range, down to its own k-th highest score,
   as nothing below can decide.
2. Spark adds the counts up; the bin that holds the k-th value becomes the next range. Rounds go
   on until a range is one value: 2 rounds for unit vectors, 7 for any numbers.
3. A last scoring lets pass what lies above that value (fewer than k rows a query) and, of the rows
   that tie with it, the k smallest ids of a block. The final rank breaks ties by the id.

What is shuffled besides vectors are at most k rows a query and block; nothing is broadcast or
collected but sizes and one number a round. Blocks are dealt by a hash of a row number that a
checkpoint has fixed, so equal vectors or ids crowd no block.

Cases: rows whose vector is null or holds null or non-finite numbers take no part. Vectors meet
those of their own length only. A row without an id is never a query; as a candidate it comes last
in a tie. A repeated id is another row: each such query row gets its own result, and may find the
other. Components beyond 64 bits end at its limits, scores beyond 2^61 count as 2^61. An empty table
gives no rows. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from menuloom.session import reliable_checkpoint

K = 5
SCALE = 256
BINS = 512
#: Rows of a block at most, and numbers in it.
CANDIDATES = 16384
QUERIES = 2048
VALUES = 4_000_000
#: Queries whose scores are held at a time within a block.
_SLICE = 256
_MOST = 1 << 61
_NONE = np.iinfo(np.int64).min
_COUNT, _HIT = (pa.schema([(c, pa.int64()) for c in names]) for names in (("q", "bin", "n"), ("q", "query_id", "vec_id", "score")))


def every_fiftieth(vec_id: Column) -> Column:
    return vec_id % 50 == 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; larger ones than ``_MOST`` end there."""
    high = [int(max(-int(x.min()), int(x.max()))) if x.size else 0 for x in (a, b)]
    bound = a.shape[1] * high[0] * high[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= _MOST:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -_MOST, _MOST).astype(np.int64)


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def slices(queries: pa.Table, rows: pa.Table, d: int):
    """(first query, scores, own) for slices of the queries; ``own`` marks the query's own row."""
    mine = rows.column("row").to_numpy()
    order = np.argsort(mine)
    q, x, y = queries.column("q").to_numpy(), matrix(queries.column("e"), d), matrix(rows.column("e"), d)
    for start in range(0, len(q), _SLICE):
        part = q[start : start + _SLICE]
        at = order[np.minimum(np.searchsorted(mine, part, sorter=order), len(mine) - 1)]
        found = np.flatnonzero(mine[at] == part)
        yield start, products(x[start : start + _SLICE], y), (found, at[found])


def histogram(queries: pa.Table, rows: pa.Table, d: int, k: int, bins: int) -> pa.Table:
    """Counts of a block by (query, bin of its range), down to the block's own k-th score."""
    low, span = (queries.column(c).to_numpy()[:, None] for c in ("low", "span"))
    q = queries.column("q").to_numpy()
    out = []
    for start, s, own in slices(queries, rows, d):
        a, w = low[start : start + len(s)], span[start : start + len(s)]
        inside = (s >= a) & (s <= a + (w - 1))
        inside[own] = False
        s = np.where(inside, s, _NONE)
        if s.shape[1] > k:
            s = np.partition(s, s.shape[1] - k, axis=1)[:, -k:]
        there = s != _NONE
        which = np.nonzero(there)[0]
        place = ((s - a) // -(-w // bins))[there]
        code, n = np.unique(which * bins + place, return_counts=True)
        out.append((q[start + code // bins], code % bins, n))
    cat = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table(dict(zip(("q", "bin", "n"), (pa.array(c, pa.int64()) for c in cat), strict=True)))


def passing(queries: pa.Table, rows: pa.Table, d: int, k: int) -> pa.Table:
    """Rows above the k-th value ``low`` of their query, and the block's k smallest ids at it."""
    low = queries.column("low").to_numpy()[:, None]
    ids = rows.column("vec_id")
    given, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    by_id = np.lexsort((number, ~given))
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    at, who, score = [], [], []
    for start, s, own in slices(queries, rows, d):
        a = low[start : start + len(s)]
        s[own] = _NONE
        tie = np.where((s == a), rank[None, :], len(rank))
        if tie.shape[1] > k:
            tie = np.partition(tie, k - 1, axis=1)[:, :k]
        i, j = np.nonzero(tie < len(rank))
        above = np.nonzero(s > a)
        i, c = np.concatenate([i, above[0]]), np.concatenate([by_id[tie[i, j]], above[1]])
        at.append(start + i)
        who.append(c)
        score.append(s[i, c])
    at, who, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, who, score))
    return pa.table({
        "q": queries.column("q").take(pa.array(at)), "query_id": queries.column("vec_id").take(pa.array(at)),
        "vec_id": ids.take(pa.array(who)), "score": pa.array(score, pa.int64()),
    })


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, is_query=every_fiftieth, scale: int = SCALE,
    bins: int = BINS, block: int = CANDIDATES, query_block: int = QUERIES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query row the k candidates with the highest
    scores, ties by the smaller id. ``is_query`` makes a condition from the id's column."""
    e = F.col("e")
    real = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    real = real.where(e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = real.select("vec_id", F.transform(e, lambda v: F.floor(v * scale).cast("long")).alias("e"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    base = reliable_checkpoint(whole.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "e", F.size(e).alias("d"), norm.alias("norm"), F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("asks"),
    ))
    n, asks, wide, most, ask_most = base.agg(
        F.count("*"), F.count_if("asks"), F.coalesce(F.max("d"), F.lit(1)), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.when(F.col("asks"), F.col("norm"))), F.lit(0.0)),
    ).first()
    parts = lambda rows, size: max(1, -(-rows // max(1, min(size, VALUES // max(1, wide)))))
    n_rows, n_queries = parts(n, block), parts(asks, query_block)
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    rows = base.select("d", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), deal(n_rows, 1).alias("cb"), "row", "vec_id", "e")
    queries = base.where("asks").select("d", deal(n_queries, 2).alias("qb"), F.col("row").alias("q"), "vec_id", "e")

    def bound(norm: Column | float) -> Column | int:
        """More than any score of a vector of this norm; rounding is far below the slack."""
        if isinstance(norm, float):
            return int(min(float(_MOST), norm * most * 1.0001 + 1))
        return F.least(F.lit(float(_MOST)), norm * most * 1.0001 + 1).cast("long")

    def meet(state: DataFrame, work, kind: pa.Schema) -> DataFrame:
        """What ``work`` gives for each block of queries, with their state, and block of rows."""
        asking = queries.join(state, "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("cb"))
        # Names of their own, as both sides come from one table.
        left = asking.select(*(F.col(c).alias(c) for c in asking.columns)).groupBy("d", "qb", "cb")
        right = rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns)).groupBy("r_d", "r_qb", "r_cb")

        def pair(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            if not (len(a) and len(b)):
                return kind.empty_table()
            return work(a, b.rename_columns([c.removeprefix("r_") for c in b.column_names]), key[0].as_py()).cast(kind)

        return left.cogroup(right).applyInArrow(pair, from_arrow_schema(kind))

    state = base.where("asks").select(F.col("row").alias("q"), (-bound(F.col("norm"))).alias("low"), (2 * bound(F.col("norm")) + 1).alias("span"), F.lit(0).cast("long").alias("above"))
    span, first = 2 * bound(float(ask_most)) + 1, True
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    while first or span > 1:
        counts = meet(state, lambda a, b, d: histogram(a, b, d, k, bins), _COUNT).groupBy("q", "bin").agg(F.sum("n").alias("n"))
        summed = counts.withColumn("upto", F.sum("n").over(down)).join(state, "q").where(F.col("above") + F.col("upto") >= k)
        place = summed.groupBy("q").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("x"))
        width = F.expr(f"(span + {bins - 1}) div {bins}")
        # A query with fewer than k candidates in all takes every one of them.
        state = reliable_checkpoint(state.join(place, "q", "left").select(
            "q", F.when(F.col("x").isNotNull(), F.col("low") + F.col("x.bin") * width).otherwise(F.lit(-_MOST - 1)).alias("low"),
            F.when(F.col("x").isNotNull(), width).otherwise(F.lit(1).cast("long")).alias("span"),
            F.when(F.col("x").isNotNull(), F.col("above") + F.col("x.upto") - F.col("x.n")).otherwise(F.col("above")).alias("above"),
        ))
        span, first = -(-span // bins), False
    hits = meet(state, lambda a, b, d: passing(a, b, d, k), _HIT)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
