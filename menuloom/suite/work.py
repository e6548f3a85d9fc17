"""Queries for uploads, the queue, staged changes, decisions, runs and mapping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..operators import groups, mapping, review, runs, workqueue
from ..schema import MACROS, MICRONUTRIENTS, Record, Rule
from ..sources import audit, upload
from .base import Tables, query

# --- uploads and the queue --------------------------------------------------------

def _bodies(t: Tables):
    """Fifty parts in a row are one upload; some bodies are empty or no array."""
    k = F.col("p_partkey")
    item = F.struct(
        F.when(k % 17 == 3, "").otherwise(F.col("p_name")).alias("name"),
        F.concat(F.lit("https://a.example/"), k).alias("menu_url"),
        F.when(k % 19 != 5, F.concat(F.lit("https://b.example/"), k)).alias("nutrition_url"),
    )
    batches = t.part.groupBy(F.floor(k / 50).cast("long").alias("batch_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(k, item.alias("i")))), lambda s: s["i"]).alias("items")
    )
    b = F.col("batch_id")
    return batches.select(b, F.when(b % 7 == 5, "[]").when(b % 7 == 6, '{"items": 1}').otherwise(F.to_json("items")).alias("body"))


_KEPT = "p_partkey // 50 % 7 < 5"


@query("s01_upload_items", f"""
SELECT p_partkey // 50 AS batch_id, (p_partkey % 50)::INTEGER AS pos, p_name AS name, 'https://a.example/' || p_partkey AS menu_url,
  'https://b.example/' || p_partkey AS nutrition_url FROM part WHERE {_KEPT} AND p_partkey % 17 <> 3 AND p_partkey % 19 <> 5""")
def upload_items(t: Tables):
    return upload.upload_items(_bodies(t))[0]


@query("s01_upload_errors", f"""
SELECT DISTINCT p_partkey // 50 AS batch_id, -1 AS pos, 'items' AS field_path, CASE p_partkey // 50 % 7 WHEN 5 THEN 'List should have at least 1 item'
  ELSE 'Input should be a valid list' END AS message FROM part WHERE NOT {_KEPT}
UNION ALL SELECT p_partkey // 50, p_partkey % 50, 'name', 'String should have at least 1 character' FROM part WHERE {_KEPT} AND p_partkey % 17 = 3
UNION ALL SELECT p_partkey // 50, p_partkey % 50, 'nutrition_url', 'Field required' FROM part WHERE {_KEPT} AND p_partkey % 19 = 5""")
def upload_errors(t: Tables):
    return upload.upload_items(_bodies(t))[1].withColumn("pos", F.col("pos").cast("long"))


def _batch(t: Tables):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit("\t"))).otherwise(F.col("p_name"))
    return t.part.select(F.floor(k / 100).cast("long").alias("batch_id"), k.alias("pos"), name.alias("name"))


_FIRST = "row_number() OVER (PARTITION BY p_partkey // 100, p_name ORDER BY p_partkey) = 1"


@query("w03_first_in_batch", f"SELECT p_partkey AS pos, p_partkey // 100 AS batch_id, CASE WHEN {_FIRST} THEN 'queued' ELSE 'skipped' END AS status FROM part")
def first_in_batch(t: Tables):
    return workqueue.enqueue_batch(_batch(t)).select("pos", "batch_id", "status")


@query("a06_batch_report", """
SELECT p_partkey // 100 AS batch_id, count(DISTINCT p_name) AS queued_count, count(*) - count(DISTINCT p_name) AS skipped_count FROM part GROUP BY 1""")
def batch_report(t: Tables):
    return workqueue.batch_report(workqueue.enqueue_batch(_batch(t)))


@query("a06_skipped_names", f"SELECT p_partkey // 100 AS batch_id, p_partkey AS pos, trim(name, ' ' || chr(9)) AS name FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) ELSE p_name END AS name FROM part) QUALIFY NOT {_FIRST}")
def skipped(t: Tables):
    out = workqueue.enqueue_batch(_batch(t)).filter(F.col("status") == "skipped")
    return out.select("batch_id", "pos", F.trim(F.regexp_replace("name", "\t", "")).alias("name"))


_STATUS = ["queued", "running", "failed", "succeeded"]


def _queue(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (k % 4 + 1).cast("int")).alias("status"),
        F.col("o_orderpriority").alias("name"), F.lit("m").alias("menu_url"), F.lit("n").alias("nutrition_url"),
        F.when(k % 4 == 2, "boom").alias("error_message"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("batch_id"),
    )


_QUEUE = f"q AS (SELECT o_orderkey AS id, ({_STATUS})[o_orderkey % 4 + 1] AS status, o_orderpriority AS name, CASE WHEN o_orderkey % 4 = 2 THEN 'boom' END AS error_message, o_orderdate, o_custkey FROM orders)"


@query("p02_status_filter", f"WITH {_QUEUE} SELECT id FROM q WHERE status = 'failed'")
def status_filter(t: Tables):
    return workqueue.with_status(_queue(t), "failed").select("id")


@query("w08_claim_oldest", f"WITH {_QUEUE} SELECT id, 'running' AS status FROM q WHERE status = 'queued' ORDER BY o_orderdate, id LIMIT 10")
def claim(t: Tables):
    return workqueue.claim_oldest(_queue(t), 10).select("id", "status")


@query("w08_claim_oldest_per_batch", f"WITH {_QUEUE} SELECT id, o_custkey AS batch_id FROM q WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id) <= 2")
def claim_per(t: Tables):
    return workqueue.claim_oldest(_queue(t), 2, ["batch_id"]).select("id", "batch_id")


def _commands(t: Tables):
    """Lines are commands on their order, in order of a unique line id."""
    seq = F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    kind = F.col("l_partkey") % 5
    edit = kind <= 2
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("item_id"), seq.alias("seq")).agg(F.min(kind).alias("kind"), F.min("l_quantity").alias("qty"))
    return lines.select(
        "item_id", "seq", F.when(F.col("kind") <= 2, "edit").when(F.col("kind") == 3, "delete").otherwise("requeue").alias("command"),
        F.when(F.col("kind") <= 1, F.concat(F.lit("new"), F.col("seq").cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("menu_url"), F.when(F.col("kind") == 2, "u").alias("nutrition_url"),
    )


_COMMANDS = f"""{_QUEUE}, c AS (SELECT l_orderkey AS item_id, l_linenumber * 1000000000000 + l_partkey * 1000 + l_suppkey AS seq, min(l_partkey % 5) AS kind FROM lineitem GROUP BY ALL),
o AS (SELECT item_id, CASE any_value(q.status) WHEN 'queued' THEN -1 WHEN 'failed' THEN min(seq) FILTER (kind = 4) END AS opened FROM c LEFT JOIN q ON id = item_id GROUP BY 1),
d AS (SELECT item_id, min(seq) AS closed FROM c JOIN o USING (item_id) WHERE kind = 3 AND seq > opened GROUP BY 1),
j AS (SELECT c.*, opened, closed, coalesce(CASE WHEN kind <= 2 THEN seq > opened AND (closed IS NULL OR seq < closed) WHEN kind = 3 THEN seq = closed ELSE seq = opened END, false) AS ok
  FROM c JOIN o USING (item_id) LEFT JOIN d USING (item_id))"""


@query("p13_refused_commands", f"WITH {_COMMANDS} SELECT item_id, seq, CASE WHEN kind <= 2 THEN 'edit' WHEN kind = 3 THEN 'delete' ELSE 'requeue' END AS command FROM j WHERE NOT ok")
def refused(t: Tables):
    return workqueue.apply_commands(_queue(t), _commands(t))[1]


@query("p13_queue_after_commands", f"""WITH {_COMMANDS},
e AS (SELECT item_id, bool_or(kind = 3) AS gone, bool_or(kind = 4) AS requeued, 'new' || (max(seq) FILTER (kind <= 1)) AS new_name, bool_or(kind = 2) AS url FROM j WHERE ok GROUP BY 1)
SELECT id, CASE WHEN requeued THEN 'queued' ELSE status END AS status, coalesce(new_name, name) AS name, CASE WHEN url THEN 'u' ELSE 'n' END AS nutrition_url,
 CASE WHEN requeued THEN NULL ELSE error_message END AS error_message FROM q LEFT JOIN e ON id = item_id WHERE NOT coalesce(gone, false)""")
def after_commands(t: Tables):
    return workqueue.apply_commands(_queue(t), _commands(t))[0].select("id", "status", "name", "nutrition_url", "error_message")


@query("j08_due_list", """SELECT c_custkey AS restaurant_id, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS swept
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def due(t: Tables):
    running = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("restaurant_id"))
    rows = workqueue.due_entities(t.customer.select(F.col("c_custkey").alias("restaurant_id")), running)
    return rows.withColumn("swept", rows.agg(F.count(F.lit(1))).scalar())


# --- staged changes ----------------------------------------------------------------

def _changes(t: Tables):
    """Orders are staged changes of their customer."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.col("o_custkey").alias("entity_id"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("published").alias("status"),
        F.when(k % 5 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("thread_id"), F.concat(F.lit("j"), k.cast("string")).alias("structured_json"),
        (k % 50).alias("agent_run_id"),
    )


_CHANGES = """ch AS (SELECT o_orderkey AS id, o_custkey AS entity_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'published' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN 't' || o_orderkey END AS thread_id, 'j' || o_orderkey AS structured_json, o_orderkey % 50 AS agent_run_id FROM orders)"""


@query("s07_idempotent_staging", """
SELECT l_orderkey AS thread_id, min(l_linenumber::BIGINT * 1000000000 + l_partkey) AS pos FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def staging(t: Tables):
    batch = t.lineitem.select(F.col("l_orderkey").alias("thread_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos")).distinct()
    existing = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("thread_id"))
    return review.new_changes(existing, batch)


@query("j02_workflow_of_change", f"WITH {_CHANGES} SELECT id, CASE WHEN agent_run_id < 25 AND agent_run_id % 2 = 1 THEN 'reviewer_workflow' ELSE 'collector_workflow' END AS workflow_type FROM ch")
def workflow(t: Tables):
    k = F.col("n_nationkey").cast("long")
    table = t.nation.select(k.alias("id"), F.when(k % 2 == 1, "reviewer_workflow").otherwise("collector_workflow").alias("workflow_type"))
    return review.with_workflow(_changes(t), table).select("id", "workflow_type")


@query("j06_not_published_elsewhere", f"WITH {_CHANGES} SELECT id FROM ch WHERE NOT EXISTS (SELECT 1 FROM ch p WHERE p.status = 'published' AND p.entity_id = ch.entity_id AND p.id <> ch.id)")
def elsewhere(t: Tables):
    changes = _changes(t)
    return review.not_published_elsewhere(changes, changes.filter(F.col("status") == "published")).select("id")


@query("j07_in_production", f"WITH {_CHANGES} SELECT id FROM ch WHERE entity_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def in_production(t: Tables):
    live = t.customer.filter(F.col("c_acctbal") > 3000).select(F.col("c_custkey").alias("entity_id"))
    return review.in_production(_changes(t), live).select("id")


def _decisions(t: Tables):
    """The first lines of an order decide on it, some with an unknown action."""
    n = F.col("l_partkey") % 4
    # Dealt by order, as they meet their change by it too.
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").repartition("l_orderkey").groupBy(
        F.col("l_orderkey").alias("proposed_change_id"), (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq")
    ).agg(F.min(n).alias("n"), F.min("l_shipdate").alias("decided_at"))
    return lines.select(
        "proposed_change_id", "seq", F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (F.col("n") + 1).cast("int")).alias("action"),
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("edited_structured_json"), F.lit("u1").alias("reviewer_user_id"),
        F.lit(None).cast("string").alias("reason"), "decided_at", F.col("seq").alias("id"),
    )


_ACTIONS = ["approve", "edit_then_approve", "reject", "maybe"]
_DECIDED = f"""{_CHANGES}, de AS (SELECT l_orderkey AS proposed_change_id, l_linenumber * 1000000000000 + l_partkey * 1000 + l_suppkey AS seq,
   ({_ACTIONS})[min(l_partkey % 4) + 1] AS action FROM lineitem GROUP BY ALL),
p AS (SELECT de.*, CASE WHEN ch.id IS NULL THEN 'not_found' WHEN status <> 'pending' THEN 'not_pending' WHEN thread_id IS NULL THEN 'no_thread' WHEN action = 'maybe' THEN 'unknown_action' END AS problem
   FROM de LEFT JOIN ch ON ch.id = proposed_change_id),
r AS (SELECT *, row_number() OVER (PARTITION BY proposed_change_id ORDER BY seq) AS rn FROM p WHERE problem IS NULL),
a AS (SELECT proposed_change_id, seq, action, CASE action WHEN 'reject' THEN 'rejected' ELSE 'approved' END AS decision FROM r WHERE rn = 1)"""


@query("d10_changes_after_decisions", f"""WITH {_DECIDED}
SELECT id, CASE WHEN decision IS NULL THEN status WHEN id % 3 = 0 THEN 'published' ELSE decision END AS status,
  CASE WHEN action = 'edit_then_approve' THEN 'e' || seq ELSE structured_json END AS structured_json FROM ch LEFT JOIN a ON id = proposed_change_id""")
def decided_changes(t: Tables):
    written = _changes(t).filter(F.col("id") % 3 == 0).select("id")
    return review.apply_decisions(_changes(t), _decisions(t), written).changes.select("id", "status", "structured_json")


@query("d10_refused_decisions", f"""WITH {_DECIDED}
SELECT proposed_change_id, seq, action, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT proposed_change_id, seq, action, 'not_pending' FROM r WHERE rn > 1""")
def refused_decisions(t: Tables):
    return review.apply_decisions(_changes(t), _decisions(t)).refused


@query("d10_approvals", f"WITH {_DECIDED} SELECT proposed_change_id, decision FROM a")
def approvals(t: Tables):
    return review.apply_decisions(_changes(t), _decisions(t)).approvals.select("proposed_change_id", "decision")


@query("w02_hot_groups", """
SELECT event_id, nullif(user_id % 3, 1) AS key, row_number() OVER w AS no, coalesce(lag(event_type) OVER w, '-') AS previous FROM events
WINDOW w AS (PARTITION BY nullif(user_id % 3, 1) ORDER BY ts, event_id)""")
def hot_groups(t: Tables):
    """Every key, the null key included, takes the path of groups too large for a task."""
    e = t.events.select("event_id", F.nullif(F.col("user_id") % 3, F.lit(1)).alias("key"), "ts", "event_type")
    conf, name = t.spark.conf, "spark.menuloom.hotGroupRows"
    before = conf.get(name, None)
    conf.set(name, "200")
    try:
        numbered = groups.number_rows(e, ["key"], ["ts", "event_id"], "no")
        out = groups.previous_value(numbered, ["key"], ["ts", "event_id"], "event_type", "previous")
    finally:
        conf.set(name, before) if before else conf.unset(name)
    return out.select("event_id", "key", "no", F.coalesce("previous", F.lit("-")).alias("previous"))


@query("s06_audit_of_decisions", f"""WITH {_DECIDED}
SELECT unnest(CASE action WHEN 'reject' THEN ['proposed_change.reject'] WHEN 'approve' THEN ['proposed_change.approve'] ELSE ['proposed_change.edit', 'proposed_change.approve'] END) AS action,
  'proposed_change' AS entity_type, proposed_change_id::VARCHAR AS entity_id, 'u1' AS actor_id, 'u1@example.com' AS actor_email, NULL::VARCHAR AS old_values, NULL::VARCHAR AS agent_run_id FROM a""")
def audit_rows(t: Tables):
    events = review.apply_decisions(_changes(t), _decisions(t)).audit
    actors = t.spark.createDataFrame([("u1", "u1@example.com")], "actor_id string, actor_email string")
    return audit.audit_rows(events, actors).select("action", "entity_type", "entity_id", "actor_id", "actor_email", "old_values", "agent_run_id")


@query("w09_latest_decision", """
SELECT l_orderkey AS proposed_change_id, (max((l_shipdate, l_linenumber * 1000000000000 + l_partkey * 1000 + l_suppkey)))[2] AS id FROM lineitem GROUP BY 1""")
def latest_decision(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("proposed_change_id"), F.col("l_shipdate").alias("decided_at"),
        (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"), F.col("l_returnflag").alias("decision"),
    )
    return review.latest_decision(rows).select("proposed_change_id", "id")


def _outcomes(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_discount") > 0.09).alias("errors"))


_ERRORS = "e AS (SELECT l_orderkey AS id, count(*) FILTER (l_discount > 0.09) AS errors FROM lineitem GROUP BY 1)"


@query("d08_collector_gate", f"""WITH {_CHANGES}, {_ERRORS}
SELECT ch.id, CASE WHEN status <> 'approved' THEN 'not_approved' WHEN errors > 0 THEN 'revalidation_failed'
 WHEN EXISTS (SELECT 1 FROM ch p WHERE p.status = 'published' AND p.entity_id = ch.entity_id AND p.id <> ch.id) THEN 'already_published' ELSE 'publish' END AS verdict
FROM ch LEFT JOIN e ON e.id = ch.id""")
def collector_gate(t: Tables):
    changes = _changes(t)
    good, bad = review.collector_gate(changes, _outcomes(t), changes.filter(F.col("status") == "published"))
    return good.select("id", F.lit("publish").alias("verdict")).unionByName(bad.select("id", F.col("refusal").alias("verdict")))


@query("d09_reviewer_gate", f"""WITH {_CHANGES}, {_ERRORS}
SELECT ch.id, CASE WHEN status <> 'approved' THEN 'not_approved' WHEN ch.id % 7 = 0 THEN 'missing_input' WHEN errors > 0 THEN 'revalidation_failed'
 WHEN entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) THEN 'not_in_production' ELSE 'publish' END AS verdict
FROM ch LEFT JOIN e ON e.id = ch.id""")
def reviewer_gate(t: Tables):
    changes = _changes(t).withColumn("delta", F.when(F.col("id") % 7 != 0, "d"))
    live = t.customer.filter(F.col("c_acctbal") > 3000).select(F.col("c_custkey").alias("entity_id"))
    good, bad = review.reviewer_gate(changes, _outcomes(t), live)
    return good.select("id", F.lit("publish").alias("verdict")).unionByName(bad.select("id", F.col("refusal").alias("verdict")))


# --- runs and failed jobs ------------------------------------------------------------

_ERROR_TEXTS = ["ConnectionError: reset", "ValueError: bad", "sqlalchemy OperationalError", "timeouterror"]


def _jobs(t: Tables):
    k = F.col("event_id")
    return t.events.select(
        k.alias("job_id"), F.element_at(F.array(*[F.lit(q) for q in runs.QUEUES]), (F.col("user_id") % 6 + 1).cast("int")).alias("queue"),
        (k % 4).cast("int").alias("attempt"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("failed_epoch"),
        F.when(k % 5 != 4, F.element_at(F.array(*[F.lit(e) for e in _ERROR_TEXTS]), (k % 5 % 4 + 1).cast("int"))).alias("exc_info"),
    ).withColumn("attempt", F.col("attempt") + 1)


_JOBS = f"jb AS (SELECT event_id AS job_id, ({list(runs.QUEUES)})[user_id % 6 + 1] AS queue, event_id % 4 + 1 AS attempt, epoch(ts)::BIGINT AS failed_epoch, event_id % 5 IN (0, 2) AS requeued FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events))"


@query("p10_f12_transient_and_retry", f"""WITH {_JOBS} SELECT job_id, requeued, coalesce(CASE WHEN requeued THEN failed_epoch + CASE attempt WHEN 1 THEN 30 WHEN 2 THEN 120 END END, -1) AS retry_at FROM jb""")
def transient(t: Tables):
    return runs.sweep_failed(_jobs(t)).select("job_id", "requeued", F.coalesce("retry_at", F.lit(-1)).alias("retry_at"))


@query("a08_dead_letter_sweep", f"WITH {_JOBS} SELECT queue, count(*) FILTER (requeued) AS requeued, count(*) FILTER (NOT requeued) AS left_for_review FROM jb GROUP BY ROLLUP (queue)")
def sweep(t: Tables):
    return runs.sweep_report(runs.sweep_failed(_jobs(t)))


@query("a09_dashboard_counters", f"""WITH {_CHANGES} SELECT (SELECT count(*) FROM customer) AS published, (SELECT count(*) FROM ch WHERE status = 'pending') AS pending_reviews,
 count(*) FILTER (event_type = 'view') AS running_runs, count(*) FILTER (event_type = 'error') AS failed_runs FROM events""")
def dashboard(t: Tables):
    table = t.events.select(F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    return runs.counters(t.customer, _changes(t), table)


@query("a10_merged_metrics", """
WITH x AS (SELECT user_id AS run_id, unnest([event_type, 'node', 'k' || (event_id % 3)]) AS key, unnest([value::VARCHAR, event_type, event_id::VARCHAR]) AS v, event_id FROM events)
SELECT run_id, string_agg(key || '=' || v, ',' ORDER BY key) AS metrics FROM (SELECT run_id, key, arg_max(v, event_id) AS v FROM x GROUP BY 1, 2) GROUP BY 1""")
def metrics(t: Tables):
    e = F.col("event_id")
    updates = t.events.select(
        F.col("user_id").alias("run_id"), e.alias("seq"),
        F.create_map(
            F.col("event_type"), F.col("value").cast("string"), F.lit("node"), F.col("event_type"),
            F.concat(F.lit("k"), (e % 3).cast("string")), e.cast("string"),
        ).alias("metrics"),
    )
    merged = runs.merge_metrics(updates)
    pairs = F.transform(F.map_entries("metrics"), lambda m: F.concat(m["key"], F.lit("="), m["value"]))
    return merged.select("run_id", F.array_join(F.array_sort(pairs), ",").alias("metrics"))


def run_events(t: Tables):
    """Five events in a row are one run: the first starts it, errors and purchases end it."""
    e = F.col("event_id")
    return t.events.select(
        F.floor(e / 5).cast("long").alias("run_id"), e.alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(e % 5 == 0, "start").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("note").alias("kind"),
        F.when(F.col("event_type") == "error", F.repeat(F.col("props"), 300)).alias("error"),
    )


RUN_SQL = """
WITH e AS (SELECT event_id // 5 AS run_id, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'start' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'note' END AS kind, props FROM events),
x AS (SELECT run_id, min(ts) FILTER (kind = 'start') AS s, arg_max(kind, (ts, event_id)) FILTER (kind IN ('failed', 'succeeded')) AS k,
  arg_max(ts, (ts, event_id)) FILTER (kind IN ('failed', 'succeeded')) AS en, arg_max(props, (ts, event_id)) FILTER (kind IN ('failed', 'succeeded')) AS p FROM e GROUP BY 1)
SELECT run_id, coalesce(k, 'running') AS status, coalesce((epoch_us(en) - epoch_us(s) + 5) // 10 / 100.0, -1) AS duration_ms,
  coalesce(CASE WHEN k = 'failed' THEN repeat(p, 300) END, '') AS error_message,
  coalesce(CASE WHEN k = 'failed' THEN substr(repeat(p, 300), 1, 2000) END, '') AS error_shown FROM x"""


@query("t04_run_lifecycle", RUN_SQL)
def lifecycle(t: Tables):
    return runs.run_lifecycle(run_events(t)).select(
        "run_id", "status", F.coalesce("duration_ms", F.lit(-1.0)).alias("duration_ms"),
        F.coalesce("error_message", F.lit("")).alias("error_message"), F.coalesce("error_shown", F.lit("")).alias("error_shown"),
    )


# --- mapping --------------------------------------------------------------------------

@query("a07_mean_if_all", """
SELECT source AS run_id, CASE WHEN count(*) FILTER (NOT (doc_id % 60 <> 7)) = 0 THEN round(sum(n_chars % 100) / count(*) / 100.0, 6) ELSE -1 END AS confidence FROM documents GROUP BY 1""")
def mean_if_all(t: Tables):
    c = F.when(F.col("doc_id") % 60 != 7, F.col("n_chars") % 100)
    return t.documents.select(F.col("source").alias("run_id"), c.alias("c")).groupBy("run_id").agg(
        F.coalesce(F.round(mapping.mean_if_all(F.col("c")) / 100.0, 6), F.lit(-1.0)).alias("confidence")
    )


@query("a11_menus_in_first_seen_order", """
SELECT l_orderkey AS run_id, l_returnflag AS menu_name, min(l_linenumber * 1000000 + l_partkey) OVER (PARTITION BY l_orderkey, l_returnflag) AS menu_order,
  l_linenumber * 1000000 + l_partkey AS category_order FROM lineitem""")
def menus(t: Tables):
    stubs = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("menu_name"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"))
    return mapping.menus_in_first_seen_order(stubs)


@query("a13_document_assembly", "SELECT source, doc_id, sha256(text) AS text_hash, greatest(1, ceil(length(text) / 700.0))::BIGINT <= 1 AS whole FROM documents")
def assembly(t: Tables):
    """Every text put together again from its sections, which are short here so that most
    texts take several."""
    out = mapping.assemble_documents(t.documents, "source", "doc_id", "doc_id", "text", section_chars=700)
    pieces = out.select("source", "piece", F.explode(F.split("content", mapping.SECTION_SEPARATOR)).alias("s"))
    named = pieces.select("source", F.regexp_extract("s", r"^\[snapshot:(\d+)\]", 1).cast("long").alias("doc_id"), F.struct("piece", F.regexp_replace("s", r"^\[snapshot:\d+\]\n", "").alias("text")).alias("p"))
    whole = named.groupBy("source", "doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("source", "doc_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("text_hash"), (F.size("p") <= 1).alias("whole"))


def _extracted(t: Tables):
    """Parts as extractor output."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    nutrient = lambda names: F.struct(*[(size / 3 if i == 0 else F.lit(None).cast("double")).alias(n) for i, n in enumerate(names)])
    return t.part.select(
        F.floor(k / 20).cast("long").alias("run_id"), (k % 4).cast("int").alias("stub_pos"), (k % 20).cast("int").alias("pos"),
        F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("name"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("image_url"),
        F.struct(F.lit("1 bowl").alias("serving_size"), nutrient(MACROS).alias("macros"), nutrient(MICRONUTRIENTS).alias("micronutrients")).alias("nutrition"),
        F.array(F.lit("milk"), F.lit("soy"), F.lit("milk")).alias("allergens"),
        F.array(F.col("p_name"), F.lit(" \t"), F.concat(F.lit(" "), "p_brand")).alias("ingredient_names"),
        F.lit(None).cast("string").alias("quantity"), (F.col("p_retailprice") / 7).alias("price"),
        F.when(k % 3 == 0, "EUR").when(k % 3 == 1, "").alias("currency"), ((k % 11) / 10.0).alias("confidence"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("s"), (k % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("source_snapshot_ids"),
    )


@query("d07_mapped_dishes", """
SELECT p_partkey // 20 AS run_id, (p_partkey % 20)::INTEGER AS pos, p_name AS name, round(p_size / 3.0, 3)::DECIMAL(12,3)::VARCHAR AS calories, round(p_retailprice / 7, 2)::DECIMAL(10,2)::VARCHAR AS price,
 CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, p_name || '|' || p_brand AS ingredients, 'milk|soy' AS allergens FROM part""")
def mapped(t: Tables):
    out = mapping.map_dishes(_extracted(t), F.concat(F.col("run_id"), F.lit(":"), F.col("stub_pos")), ["run_id", "pos", "name"])
    return out.select(
        "run_id", "pos", "name", F.col("nutrition.macros.calories").cast("string").alias("calories"), F.col("price").cast("string").alias("price"), "currency",
        F.array_join("ingredients.name", "|").alias("ingredients"), F.array_join("allergens", "|").alias("allergens"),
    )


@query("a14_extraction_metadata", """
SELECT p_partkey // 20 AS run_id, (p_partkey % 4)::INTEGER AS stub_pos, (p_partkey % 20)::INTEGER AS pos, ' ' || p_name || '  ' AS name, (p_partkey % 11) / 10.0 AS confidence,
 CASE WHEN p_partkey % 2 = 0 THEN 's' || (p_partkey % 5) END AS source_snapshot_id FROM part""")
def metadata(t: Tables):
    return mapping.extraction_metadata(_extracted(t))


@query("d06_merged_profiles", """
SELECT c_custkey AS restaurant_id, CASE WHEN c_custkey % 3 = 1 THEN 'new ' || c_name ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'thai' ELSE 'diner' END AS cuisine_types FROM customer""")
def merged_profiles(t: Tables):
    k = F.col("c_custkey")
    base = t.customer.select(
        k.alias("restaurant_id"), F.col("c_mktsegment").alias("description"), F.lit("l").alias("logo_url"), F.lit("c").alias("cover_image_url"), F.array(F.lit("diner")).alias("cuisine_types"),
    )
    profiles = t.customer.filter(k % 3 != 0).select(
        k.alias("restaurant_id"), F.when(k % 3 == 1, F.concat(F.lit("new "), "c_name")).otherwise("").alias("description"), F.lit(None).cast("string").alias("logo_url"),
        F.lit("").alias("cover_image_url"), F.when(k % 4 == 0, F.array(F.lit("thai"))).otherwise(F.array().cast("array<string>")).alias("cuisine_types"),
    )
    return mapping.merge_profiles(base, profiles).select("restaurant_id", "description", F.array_join("cuisine_types", "|").alias("cuisine_types"))


@query("d06_merged_menus", """
SELECT o_custkey AS restaurant_id, 'live' || o_orderkey AS menu FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'fresh' || c_custkey FROM customer WHERE c_custkey % 4 = 0""")
def merged_menus(t: Tables):
    current = t.orders.select(F.col("o_custkey").alias("restaurant_id"), F.concat(F.lit("live"), F.col("o_orderkey").cast("string")).alias("menu"))
    fresh = t.customer.filter(F.col("c_custkey") % 4 == 0).select(F.col("c_custkey").alias("restaurant_id"), F.concat(F.lit("fresh"), F.col("c_custkey").cast("string")).alias("menu"))
    return mapping.merge_menus(current, fresh)


LINE_RECORD = Record((Rule("title", required=True, nullable=False, min_len=1, max_len=40, not_blank=True), Rule("words", "int", required=True, ge=1)))


def first_lines(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic extractor: the first line, and the number of lines."""
    text = pdf["text"].str
    return pd.DataFrame({"doc_id": pdf["doc_id"], "title": text.split("\n").str[0].fillna(""), "words": text.count("\n").astype("int32")})


_LINES = "x AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, length(text) - length(replace(text, chr(10), '')) AS words FROM documents)"


@query("u03_extraction_hook", f"WITH {_LINES} SELECT doc_id, title FROM x WHERE length(title) BETWEEN 1 AND 40 AND trim(title) <> '' AND words >= 1")
def extraction(t: Tables):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("words", T.IntegerType())])
    found = mapping.extract(t.documents.select("doc_id", "text"), first_lines, schema, ["doc_id"], LINE_RECORD)
    return found.rows.select("doc_id", "title")


def page_categories(pdf: pd.DataFrame) -> pd.DataFrame:
    """Phase 1: up to three categories of a page in two menus; some pages cannot be read."""
    n = int(pdf["page_id"][0])
    if n % 11 == 3:
        raise ValueError(f"page {n} cannot be read")
    return pd.DataFrame({"menu_name": [f"m{i % 2}" for i in range(n % 4)], "category_name": [f"c{i}" for i in range(n % 4)]})


def category_dishes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Phase 2: the dishes of one category; some calls fail, some names break the schema."""
    n, category, size = int(pdf["page_id"][0]), pdf["category_name"][0], len(pdf["html"][0])
    if n % 7 == 5 and category == "c1":
        raise ValueError(f"no answer for {category} of {n}")
    return pd.DataFrame({"pos": range(n % 3 + 1), "name": ["" if p == 2 else f"{category} {size} {p}" for p in range(n % 3 + 1)]})


PAGE_DISHES = T.StructType([T.StructField(n, k) for n, k in (
    ("owner", T.LongType()), ("stub_pos", T.IntegerType()), ("pos", T.IntegerType()), ("menu_name", T.StringType()), ("category_name", T.StringType()), ("name", T.StringType()),
)])
PAGE_RECORD = Record((Rule("menu_name", required=True), Rule("category_name", required=True), Rule("name", required=True, min_len=1)))


def _two_phases(t: Tables) -> mapping.Extracted:
    """Two pages are one owner, as two pieces of its material."""
    k = F.col("page_id")
    docs = t.pages.select(F.floor(k / 2).alias("owner"), F.lit(0).cast("long").alias("part"), (k % 2).cast("int").alias("piece"), "page_id", "html")
    return mapping.extract_by_category(docs, mapping.TwoPhase(page_categories, category_dishes), PAGE_DISHES, ["owner", "stub_pos", "pos"], PAGE_RECORD)


_TWO_PHASES = """WITH p AS (SELECT page_id, page_id // 2 AS owner, length(html) AS size FROM pages),
s AS (SELECT p.*, i, row_number() OVER (PARTITION BY owner ORDER BY page_id, i) - 1 AS stub_pos FROM p, unnest(range(page_id % 4)) AS t(i) WHERE page_id % 11 <> 3),
bad1 AS (SELECT owner, page_id FROM p WHERE page_id % 11 = 3),
bad2 AS (SELECT owner, page_id FROM s WHERE page_id % 7 = 5 AND i = 1 AND owner NOT IN (SELECT owner FROM bad1))"""


@query("u03_two_phase_rows", f"""{_TWO_PHASES}
SELECT owner, stub_pos, pos::INTEGER AS pos, 'm' || (i % 2) AS menu_name, 'c' || i || ' ' || size || ' ' || pos AS name FROM s, unnest(range(page_id % 3 + 1)) AS d(pos)
WHERE pos < 2 AND owner NOT IN (SELECT owner FROM bad1 UNION ALL SELECT owner FROM bad2)""")
def two_phase_rows(t: Tables):
    """A failed call of either phase takes all rows of its owner; nothing else stops."""
    return _two_phases(t).rows.select("owner", F.col("stub_pos").cast("long").alias("stub_pos"), "pos", "menu_name", "name")


@query("u03_two_phase_failures", f"""{_TWO_PHASES}
SELECT owner, 'discovery' AS phase, 'ValueError: page ' || page_id || ' cannot be read' AS message FROM bad1
UNION ALL SELECT owner, 'category', 'ValueError: no answer for c1 of ' || page_id FROM bad2""")
def two_phase_failures(t: Tables):
    return _two_phases(t).failures
