"""Near-duplicate embeddings by an inverted multi-index: independent codebooks for the
two halves of the unit vectors form a product grid of cells; each vector visits cells
in the order of their distance until no further cell can hold a partner, and
what it meets there is verified with the cosine in double precision.

A pair with cosine >= t is at most r = sqrt(2 - 2t) apart, split over the halves. A
vector of another Voronoi cell is at least as far as the plane between the two
codewords, so a cell is worth a visit only while the squared distances to the planes of
both halves sum to at most r squared. The traversal stops there, which makes its recall
1 by construction (``radius`` below 1 trades recall for fewer cells); tests measure it
against brute force.

Copies: equal vectors with one label form a class, stood for by its smallest id, so
a group of any size costs one row. A crowded cell is dealt into chunks of bounded size
and visitors into groups, so no task holds more than ``CHUNK`` by ``VISITORS`` rows, and
it sends on numbers of links and a spanning forest, never all pairs.

Cases: rows whose vector is null, empty, zero, or has null or non-finite components, and rows
without a label or id, link with nothing; vectors meet those of their own length only (the ``LENGTHS``
commonest lengths have codebooks of their own, a rarer one has a single cell a label); each row in gives
one row out, so a repeated id counts as another vector; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from menuloom.session import reliable_checkpoint

from .common import components, forest

THRESHOLD = 0.98
#: Vectors that codebooks are trained on, at most (smallest digests of the ids).
SAMPLE = 20_000
#: Codewords of a half, at most; cells aim at ``PER_CELL`` vectors of a label.
CODEWORDS = 128
PER_CELL = 100
#: Vector lengths with codebooks, at most.
LENGTHS = 64
CHUNK = 512
VISITORS = 4096
_SLACK = 1e-7


def unit_rows(values: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows are fit to compare."""
    x = np.zeros((len(values), size))
    good = np.zeros(len(values), bool)
    for i, v in enumerate(values):
        if v is not None and len(v) == size:
            row = np.asarray(v, dtype=object) if not isinstance(v, np.ndarray) else v
            row = np.array([np.nan if c is None else c for c in row], float) if row.dtype == object else row.astype(float)
            if np.isfinite(row).all():
                scale = np.abs(row).max()
                if scale > 0:
                    row = row / scale
                    x[i], good[i] = row / np.sqrt((row * row).sum()), True
    return x, good


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords by Lloyd's rounds, started from spread rows of the sample."""
    k = min(k, len(x))
    if not k or not x.shape[1]:
        return np.zeros((1, x.shape[1]))
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        for j in range(k):
            mine = x[near == j]
            if len(mine):
                words[j] = mine.mean(axis=0)
    return np.unique(words, axis=0)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return distances(x, words).argmin(axis=1)


def plane_distances(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own codeword of each row, and the squared distance to the plane behind which
    another codeword is nearer (0 for the own)."""
    d = distances(x, words)
    own = d.argmin(axis=1)
    gap = np.sqrt(distances(words, words))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d - d[np.arange(len(x)), own][:, None]) / (2 * gap), 0)
    return own, np.maximum(plane - _SLACK, 0) ** 2


def traverse(x: np.ndarray, one: np.ndarray, two: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) for all cells to visit, and the own cell of each row. Both halves' lists
    are walked by rising distance; a row of the grid ends where the sum passes the limit."""
    half = x.shape[1] // 2
    own1, p1 = plane_distances(x[:, :half], one)
    own2, p2 = plane_distances(x[:, half:], two)
    order1, order2 = np.argsort(p1, axis=1, kind="stable"), np.argsort(p2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(p1, order1, 1), np.take_along_axis(p2, order2, 1)
    rows, cells = [], []
    for i in range(s1.shape[1]):
        left = limit - s1[:, i]
        if not (left >= 0).any():
            break
        for j in range(s2.shape[1]):
            r = np.flatnonzero(s2[:, j] <= left)
            if not len(r):
                break
            rows.append(r)
            cells.append(order1[r, i].astype(np.int64) * len(two) + order2[r, j])
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cells or [np.zeros(0, np.int64)]), own1.astype(np.int64) * len(two) + own2


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    sample: int = SAMPLE, radius: float = 1.0,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.col(label).cast("string").alias("label"))
    fit = rows.where(
        (F.size("e") > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    )
    # -0.0 and 0.0 are one value here.
    fit = fit.withColumn("e", F.transform("e", lambda v: v + F.lit(0.0)))
    classes = reliable_checkpoint(fit.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    labels = classes.select("label").distinct().count()
    k = int(min(CODEWORDS, max(2, (n / labels / PER_CELL) ** 0.5 + 1)))
    part = classes.where(F.abs(F.xxhash64("rep")) % 1_000_000 < int(1_000_000 * min(1.0, sample / n)) + 1).select("rep", "e").limit(2 * sample).toPandas().sort_values("rep")
    lengths = part["e"].map(len)
    trained = {}
    for size in lengths.value_counts().index[:LENGTHS]:
        x, good = unit_rows(list(part["e"][lengths == size]), size)
        x = x[good] if good.any() else np.eye(1, size)
        trained[int(size)] = codebook(x[:, : size // 2], k), codebook(x[:, size // 2 :], k)
    books = spark.sparkContext.broadcast(trained)
    limit = (2 - 2 * threshold) * radius**2 + _SLACK

    def visit(frames):
        for frame in frames:
            for size, same in frame.groupby(frame["e"].map(len)):
                one, two = books.value.get(size) or (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))
                for start in range(0, len(same), 2048):
                    f = same.iloc[start : start + 2048]
                    x, _ = unit_rows(list(f["e"]), size)
                    at, cell, own = traverse(x, one, two, limit)
                    yield pd.DataFrame({"rep": f["rep"].to_numpy()[at], "label": f["label"].to_numpy()[at], "cell": cell, "home": cell == own[at]})

    # Lengths never meet, so cells are those of a length and a label.
    placed = F.concat_ws(":", F.size("e").cast("string"), "label").alias("label")
    visits = reliable_checkpoint(classes.select("rep", "e", placed).mapInPandas(visit, "rep long, label string, cell long, home boolean"))
    cells = visits.groupBy("label", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("visits"))
    cells = cells.where("homes > 0 AND visits > 1").select(
        "label", "cell", F.ceil(F.col("homes") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("visits") / VISITORS).cast("int").alias("groups"),
    )
    placed = visits.join(cells, ["label", "cell"])
    pick = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    homes = placed.where("home").select("rep", "label", "cell", pick("chunks", 1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(True).alias("home"))
    visitors = placed.select("rep", "label", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), pick("groups", 2).alias("group"), F.lit(False).alias("home"))
    meet = homes.union(visitors).join(classes.select("rep", "e", "copies"), "rep")

    def verify(rows: pa.Table) -> pa.Table:
        home = rows.column("home").to_numpy(zero_copy_only=False)
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        e = rows.column("e").combine_chunks()
        x, _ = unit_rows(list(e.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)), len(e.values) // max(1, len(ids)))
        h, v = np.flatnonzero(home), np.flatnonzero(~home)
        out_id, out_links, out_a, out_b = [], [], [], []
        if len(h) and len(v):
            number = {i: k for k, i in enumerate(dict.fromkeys(ids.tolist()))}
            pairs_a, pairs_b = [], []
            for start in range(0, len(v), 1024):
                mine = v[start : start + 1024]
                near = (x[mine] @ x[h].T >= threshold) & (ids[mine][:, None] != ids[h][None, :])
                links = near @ copies[h]
                some = links > 0
                out_id += ids[mine][some].tolist()
                out_links += links[some].tolist()
                i, j = np.nonzero(near)
                pairs_a.append(ids[mine][i])
                pairs_b.append(ids[h][j])
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            at = np.array([number[i] for i in a.tolist()], np.int64), np.array([number[i] for i in b.tolist()], np.int64)
            tree = forest(*at, len(number))
            out_a, out_b = a[tree].tolist(), b[tree].tolist()
        nulls = [None] * len(out_id), [None] * len(out_a)
        return pa.table({
            "rep": pa.array(out_id + nulls[1], pa.int64()), "links": pa.array(out_links + nulls[1], pa.int64()),
            "a": pa.array(nulls[0] + out_a, pa.int64()), "b": pa.array(nulls[0] + out_b, pa.int64()),
        })

    found = reliable_checkpoint(meet.groupBy("label", "cell", "chunk", "group").applyInArrow(verify, "rep long, links long, a long, b long"))
    links = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("a IS NOT NULL").select("a", "b"))
    named = classes.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("c_label"), F.col("e").alias("c_e"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    )
    other = rows.withColumn("e", F.transform("e", lambda v: v + F.lit(0.0)))
    out = other.join(named, (F.col("label") == F.col("c_label")) & (F.col("e") == F.col("c_e")) & F.col("vec_id").isNotNull(), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
