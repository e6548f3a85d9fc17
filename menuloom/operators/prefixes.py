"""First rule whose prefix a text begins with, for groups and rule lists of any size.

The texts that begin with a prefix are a range in sorted order, and such ranges are either
nested or apart. So texts and rules are sorted together, in even chunks by range, and each
chunk is read once with a stack of the prefixes that are open. The stack on entering a chunk
consists of the prefixes of its first text, which equality joins find; no chunk waits for
another, no group is one task, and no list of rules is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import reliable_checkpoint


def _earlier(a: dict, b: dict) -> dict:
    """The one of two rules that comes first: by ``seq``, ``allow`` and prefix, null before all."""
    def place(r):
        return [(r[f] is not None, r[f]) for f in ("seq", "allow", "prefix")]

    for x, y in zip(place(a), place(b)):
        if x != y:
            return a if (x[0], y[0]) == (False, True) or (x[0] == y[0] and x[1] < y[1]) else b
    return a


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk; entering rules, then rules and texts in order, a rule before
    a text equal to it. Memory holds the open prefixes and a batch."""
    chunk, group, stack = None, None, []
    for batch in batches:
        groups, texts, verdicts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("_chunk", "_group", "_text", "_rule")]
        for c, g, text, rule in zip(*columns):
            if c != chunk or g != group:
                chunk, group, stack = c, g, []
            while stack and not text.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((text, _earlier(stack[-1][1], rule) if stack else rule))
            elif stack:
                groups.append(g), texts.append(text), verdicts.append(stack[-1][1]["verdict"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups, batch.schema.field("_group").type), pa.array(texts, batch.schema.field("_text").type), pa.array(verdicts, pa.bool_())],
            names=["_group", "_text", "_verdict"],
        )


def first_prefix_rule(texts: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(_group, _text, _verdict) of the texts that some rule of their group covers.

    ``texts`` are distinct (_group, _text) and ``rules`` (_group, _text, seq, allow, prefix,
    verdict), where ``_text`` is the prefix; none of ``_group`` and ``_text`` is null. Of the rules
    that cover a text the first by (seq, allow, prefix) decides. ``parts`` is the number of
    chunks, by default one per shuffle partition."""
    parts = parts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One rule a prefix, chosen map-side.
    folded = rules.groupBy("_group", "_text").agg(F.min(F.struct("seq", "allow", "prefix", "verdict")).alias("_rule"))
    kind = folded.schema["_rule"].dataType
    both = folded.withColumn("_order", F.lit(1)).unionByName(
        texts.select("_group", "_text", F.lit(None).cast(kind).alias("_rule"), F.lit(2).alias("_order"))
    )
    # Fixed, so that a lost executor cannot deal the rows out anew.
    ranged = reliable_checkpoint(
        both.repartitionByRange(parts, "_group", "_text", "_order").withColumn("_chunk", F.spark_partition_id())
    )
    # One row a chunk, times the lengths of its group's prefixes: no more text than one rule of each length has.
    firsts = ranged.groupBy("_chunk").agg(F.min(F.struct("_group", "_text")).alias("_first")).select("_chunk", "_first.*")
    lengths = folded.groupBy("_group", F.length("_text").alias("_length")).agg(F.lit(0).cast("int").alias("_order"))
    heads = firsts.join(lengths, "_group").filter(F.col("_length") <= F.length("_text")).select(
        "_chunk", "_group", F.expr("substring(_text, 1, _length)").alias("_text"), "_order"
    )
    entering = heads.join(folded, ["_group", "_text"])
    ordered = ranged.unionByName(entering).repartition(parts, "_chunk").sortWithinPartitions(
        "_chunk", F.col("_order") > 0, "_group", "_text", "_order"
    )
    out = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("_group", "_text")) + ", _verdict boolean"
    return ordered.select("_chunk", "_group", "_text", "_rule").mapInArrow(_sweep, out)
