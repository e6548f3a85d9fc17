"""The ingestion queue as a table: batches, guarded commands, claims, due work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import batch_name_key
from .groups import first_rows, top_of_group

EDITABLE = ("name", "menu_url", "nutrition_url")


def enqueue_batch(items: DataFrame, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """First of each name in a batch is queued, later ones are skipped."""
    keyed = items.withColumn("name_key", batch_name_key(F.col("name")))
    return first_rows(keyed, [batch, "name_key"], pos, "_first").withColumn(
        "status", F.when(F.col("_first"), "queued").otherwise("skipped")
    ).drop("_first", "name_key")


def batch_report(enqueued: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Queued and skipped counts per batch. The skipped names, in order, are the
    skipped rows of ``enqueued`` sorted by position."""
    return enqueued.groupBy(batch).agg(
        F.count_if(F.col("status") == "queued").alias("queued_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"),
    )


def with_status(df: DataFrame, status: str | None = None) -> DataFrame:
    return df if status is None else df.filter(F.col("status") == status)


def apply_commands(queue: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue afterwards, refused commands). Edit and delete need a queued item,
    requeue a failed one and clears its error; commands act in ``seq`` order.

    An item accepts edits and deletes from the moment it is queued (at once, or
    after its first requeue if it failed) until its first such delete. These
    moments are map-side minima, so no item's commands are gathered."""
    start = commands.join(queue.select(F.col("id").alias("item_id"), "status"), "item_id", "left")
    opened = start.groupBy("item_id").agg(
        F.min(F.when(F.col("status") == "queued", F.lit(-1).cast("long"))
              .when((F.col("status") == "failed") & (F.col("command") == "requeue"), F.col("seq"))).alias("_open")
    )
    timed = start.join(opened, "item_id")
    closed = timed.filter((F.col("command") == "delete") & (F.col("seq") > F.col("_open"))).groupBy("item_id").agg(
        F.min("seq").alias("_closed")
    )
    judged = timed.join(closed, "item_id", "left").withColumn(
        "_ok",
        F.coalesce(
            F.when(F.col("command") == "edit", (F.col("seq") > F.col("_open")) & (F.col("_closed").isNull() | (F.col("seq") < F.col("_closed"))))
            .when(F.col("command") == "delete", F.col("seq") == F.col("_closed"))
            .when(F.col("command") == "requeue", F.col("seq") == F.col("_open")),
            F.lit(False),
        ),
    )
    edit = F.col("command") == "edit"
    effects = judged.filter("_ok").groupBy(F.col("item_id").alias("id")).agg(
        F.bool_or(F.col("command") == "delete").alias("_gone"),
        F.bool_or(F.col("command") == "requeue").alias("_requeued"),
        *[F.max_by(F.col(c), F.when(edit & F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in EDITABLE],
    )
    after = (
        queue.join(effects, "id", "left")
        .filter(~F.coalesce("_gone", F.lit(False)))
        .withColumn("error_message", F.when(F.coalesce("_requeued", F.lit(False)), F.lit(None)).otherwise(F.col("error_message")))
        .withColumn("status", F.when(F.coalesce("_requeued", F.lit(False)), "queued").otherwise(F.col("status")))
    )
    for c in EDITABLE:
        after = after.withColumn(c, F.coalesce(f"_{c}", c))
    refused = judged.filter(~F.col("_ok")).select("item_id", "seq", "command")
    return after.select(*queue.columns), refused


def claim_oldest(queue: DataFrame, n: int = 1, per: Sequence[str] = ()) -> DataFrame:
    """The oldest n queued items, overall or per group, now running."""
    queued = queue.filter(F.col("status") == "queued")
    if per:
        chosen = top_of_group(queued, per, [F.col("created_at"), F.col("id")], n)
    else:
        chosen = queued.orderBy("created_at", "id").limit(n)
    return chosen.withColumn("status", F.lit("running"))


def due_entities(entities: DataFrame, running: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """Published entities without a run in flight; each becomes one work item."""
    return entities.select(key).join(running.select(key), key, "left_anti")
