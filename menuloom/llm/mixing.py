"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame
operations only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
all sizes; a target stops at ``cap`` times its source's size and the excess goes to
the others by weight until none is above.

Draw: a document's key is -ln(u) / quality with u drawn from a digest of its id, so
small keys come first and better documents sooner. Complete epochs over a source
precede the fractional one, which takes documents by rising key until the prefix sum of
sizes reaches the budget; the document at the edge gives its leading words, so the words
taken equal the budget.

A prefix sum over a hot source never meets in one task: keys are dealt into bins by a
monotone function of the key, sums of bins find the bin in which the budget ends, and
only that bin is ordered. Bins are even for the least quality, and as dense as its inverse
(four times) for the highest, so a bin has about four times the root of the rows at most, whatever
the qualities are. All other documents compare their key with the source's threshold.

Cases: null and empty texts have size 0 and are never taken; null sources form one
source; null ids draw as an empty id; rows with one id tie and share what is left of
the budget by size; a source without words has target 0; an empty table gives no rows.
Columns of the input that have an output's name are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from menuloom.session import broadcast_if_small, reliable_checkpoint

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
#: The least quality that bins are made for; lower ones are mixed right, in fuller bins.
LEAST_QUALITY = 0.25
OUTPUT = ("size", "source_size", "target", "taken")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def prose_quality(size: Column, text: str = "text") -> Column:
    """Between 0.25 and 1: highest where words are about as long as in prose."""
    off = (F.length(text).cast("double") / size.cast("double") - F.lit(6.0)) / F.lit(3.0)
    return F.when(size > 0, F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) / (F.lit(1.0) + off * off))).otherwise(F.lit(LEAST_QUALITY))


def draw_key(doc_id: str, quality: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality, u in (0, 1] from the first 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _tie(doc_id)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(2**52))
    return -F.log(u) / quality


def bin_number(key: Column, bins: int, least_quality: float = LEAST_QUALITY) -> Column:
    """The bin of a key; it never falls as the key rises."""
    return F.floor((F.lit(1.0) - F.exp(-key * F.lit(least_quality))) * bins).cast("long")


def _tie(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size). Each round sums
    what the capped sources take and what the others weigh; the level only rises."""
    ranked = reliable_checkpoint(_ranked(sizes).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"),
    ).withColumn("most", F.col("source_size") * cap))
    total, heavy = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    if not total:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    level, capped = total / heavy, -1
    while True:
        n, taken, weight = ranked.where(F.col("w") * F.lit(level) > F.col("most")).agg(F.count("*"), F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == capped or weight == heavy:
            break
        level, capped = (total - taken) / (heavy - weight), n
    share = F.col("w") * F.lit(float(level))
    return ranked.select("source", "source_size", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """A rank from 0 in code point order, null last, without one task for all sources."""
    spark = sizes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = reliable_checkpoint(ordered)
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # One row a partition.
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("inside", inside).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside") - 1).alias("rank"))


def mix(
    docs: DataFrame, size: Column, quality: Column, doc_id: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, narrow: bool = False, least_quality: float = LEAST_QUALITY,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words taken, repeats counted).
    ``size`` and ``quality`` are expressions over the documents. ``narrow`` returns the id
    and the source only, from the small fixed table, without another pass over texts."""
    key = draw_key(doc_id, quality, seed)
    fixed = reliable_checkpoint(docs.select(
        F.col(doc_id).alias("id"), _tie(doc_id).alias("tie"), F.col(source).cast("string").alias("source"), size.alias("size"), key.alias("key"),
    ))
    rows = fixed.count()
    bins = max(16, int(rows**0.5))
    bin_of = bin_number(F.col("key"), bins, least_quality)
    sums = reliable_checkpoint(fixed.withColumn("bin", bin_of).groupBy("source", "bin").agg(F.sum("size").alias("size")))

    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole, own = F.floor("target").cast("long"), F.col("source_size")
    budget = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(own > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long").alias("epochs"),
        F.when(own > 0, whole % own).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    budget = reliable_checkpoint(budget)

    # The bin in which the fractional budget ends, then the document.
    same = lambda f: f["source"].eqNullSafe(F.col("s"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("size").over(by_bin), F.lit(0)))
    edge = edge.join(budget, same(edge)).where((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("size")))
    edge = broadcast_if_small(edge.select("s", F.col("bin").alias("b"), (F.col("rest") - F.col("before")).alias("left")))
    inside = fixed.withColumn("bin", bin_of).join(edge, same(fixed) & (F.col("bin") == F.col("b")))
    ties = inside.groupBy("source", "left", "key", "tie").agg(F.sum("size").alias("size"))
    by_key = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = ties.withColumn("before", F.coalesce(F.sum("size").over(by_key), F.lit(0)))
    last = last.where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("size")))
    last = last.select(F.col("source").alias("ls"), F.col("key").alias("last_key"), F.col("tie").alias("last_tie"), (F.col("left") - F.col("before")).alias("last_rest"), F.col("size").alias("last_size"))
    plan = broadcast_if_small(budget.join(last, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls"))

    if narrow:
        rows_in, carried = fixed.select(F.col("id").alias(doc_id), F.col("source").alias(source), *(F.col(c).alias(f"__{c}") for c in ("tie", "size", "key"))), [doc_id, source]
    else:
        carried = [c for c in docs.columns if c not in OUTPUT]
        rows_in = docs.select(*carried, _tie(doc_id).alias("__tie"), size.alias("__size"), key.alias("__key"))
    joined = rows_in.join(plan, rows_in[source].cast("string").eqNullSafe(F.col("s")), "left")
    k, t = F.col("__key"), F.col("__tie")
    part = (
        F.when((k < F.col("last_key")) | ((k == F.col("last_key")) & (t < F.col("last_tie"))), F.col("__size"))
        .when((k == F.col("last_key")) & (t == F.col("last_tie")), F.expr("(__size * last_rest) div last_size"))
        .otherwise(F.lit(0))
    )
    return joined.select(
        *carried, F.col("__size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("__size") + part).cast("long").alias("taken"),
    )
