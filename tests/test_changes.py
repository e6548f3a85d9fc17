"""Differences, patches, decisions, gates, queue, mapping."""

import json

import pandas as pd
from pyspark.sql import functions as F, types as T

from menuloom.operators import authority, delta, groups, listing, mapping, review, runs, workqueue
from menuloom.schema import EXTRACTED_DISH, MACROS, MICRONUTRIENTS, Record, Rule


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


DISHES = "k string, name string, price decimal(10,2), tags array<string>, id string"


def versions(spark):
    from decimal import Decimal as D

    current = spark.createDataFrame(
        [("a", "A", D("9.99"), ["x", "y"], "1"), ("b", "B", D("1.00"), [], "2"), ("c", "C", None, None, "3"), ("d", "D", D("5.00"), ["t"], "4")], DISHES
    )
    target = spark.createDataFrame(
        [("a", "A", D("11.99"), ["y", "x"], "9"), ("c", "C", D("2.00"), None, "8"), ("d", "D", D("5.00"), ["t"], "7"), ("e", "E", None, ["z"], "6")], DISHES
    )
    return current, target


def test_diff_and_patch_law(spark):
    current, target = versions(spark)
    found = delta.table_diff(current, target, ["k"])
    assert rows(found, "k", "field", "op", "old_value", "new_value") == sorted([
        ("a", "price", "changed", "9.99", "11.99"),
        ("b", None, "removed", '{"name":"B","price":1.00,"tags":[]}', None),
        ("c", "price", "changed", None, "2.00"),
        ("e", None, "added", None, '{"name":"E","tags":["z"]}'),
    ], key=repr)
    patched = delta.patch_rows(current, target, found, ["k"])
    assert delta.table_diff(patched, target, ["k"]).count() == 0
    # an untouched row keeps its own id, a touched one is the target's
    assert dict(rows(patched, "k", "id")) == {"a": "9", "c": "8", "d": "4", "e": "6"}
    assert delta.table_diff(current, current, ["k"]).count() == 0
    assert rows(delta.patch_rows(current, target, found.limit(0), ["k"]), "k", "id") == rows(current, "k", "id")
    assert rows(delta.touched_keys(found, ["k"]), "k") == [("a",), ("c",), ("e",)]


def test_removed_and_changed_at_once_and_unknown_key(spark):
    current, target = versions(spark)
    mixed = spark.createDataFrame([("a", "price", "changed"), ("a", None, "removed"), ("zz", "price", "changed")], "k string, field string, op string")
    assert rows(delta.patch_rows(current, target, mixed, ["k"]), "k") == [("b",), ("c",), ("d",)]


def test_natural_key_for_hot_names(spark, hot_groups):
    df = spark.range(30).select(F.lit("r").alias("r"), F.when(F.col("id") % 3 == 0, " Soup").otherwise("soup").alias("name"), F.col("id").alias("pos"))
    got = delta.with_natural_key(df, ["r"], ["pos"])
    assert rows(got, "name_key", "pos", "occurrence") == sorted([("soup", i, i + 1) for i in range(30)], key=repr)


def test_scope_and_provenance(spark):
    issues = spark.createDataFrame([("r", "d1", "error"), ("r", "d2", "warning"), ("r", None, "warning")], "r string, d string, severity string")
    touched = spark.createDataFrame([("d2",)], "d string")
    assert rows(delta.scoped_issues(issues, touched, ["d"]), "d") == [("d2",), (None,)] or len(rows(delta.scoped_issues(issues, touched, ["d"]), "d")) == 2
    assert delta.scoped_issues(issues, None, ["d"]).count() == 3
    report = delta.scoped_report(issues.select("r").distinct(), issues, touched, "r", ["d"]).first()
    assert (report.errors, report.is_valid, report.reported_issues) == (1, False, 2)
    changes = spark.createDataFrame(
        [("r", "d1", "price", "changed"), ("r", "d2", None, "removed"), ("r", "", "description", "changed"), ("r", "", "website_url", "changed")],
        "r string, d string, field string, op string",
    )
    row_refs = spark.createDataFrame([("r", "d1", ["s1"]), ("r", "d2", ["s2"])], "r string, d string, source_snapshot_ids array<string>")
    profile = spark.createDataFrame([("r", ["s9"])], "r string, source_snapshot_ids array<string>")
    got = delta.with_provenance(changes, row_refs, profile, ["r", "d"], "r")
    assert {(r.d, r.field): r.source_snapshot_ids for r in got.collect()} == {
        ("d1", "price"): ["s1"], ("d2", None): [], ("", "description"): ["s9"], ("", "website_url"): [],
    }


CHANGES = "id string, entity_id string, status string, thread_id string, structured_json string, agent_run_id string"


def test_decisions(spark):
    changes = spark.createDataFrame(
        [("1", "e1", "pending", "t1", "j1", None), ("2", "e2", "pending", "t2", "j2", "r"), ("3", "e3", "pending", None, "j3", None), ("4", "e4", "published", "t4", "j4", None)], CHANGES
    )
    decisions = spark.createDataFrame(
        [("1", 1, "maybe", None), ("1", 2, "edit_then_approve", "new"), ("1", 3, "reject", None), ("2", 1, "reject", None),
         ("3", 1, "approve", None), ("4", 1, "approve", None), ("9", 1, "approve", None)],
        "proposed_change_id string, seq long, action string, edited_structured_json string",
    ).withColumns({"reviewer_user_id": F.lit("u"), "reason": F.lit(None).cast("string"), "decided_at": F.lit("2026-01-01").cast("timestamp")})
    out = review.apply_decisions(changes, decisions, spark.createDataFrame([("1",), ("2",), ("4",)], "id string"))
    # rejecting never publishes unless the data was written
    assert rows(out.changes, "id", "status", "structured_json") == [
        ("1", "published", "new"), ("2", "published", "j2"), ("3", "pending", "j3"), ("4", "published", "j4")]
    assert rows(out.refused, "proposed_change_id", "seq", "problem") == [
        ("1", 1, "unknown_action"), ("1", 3, "not_pending"), ("3", 1, "no_thread"), ("4", 1, "not_pending"), ("9", 1, "not_found")]
    assert rows(out.audit, "entity_id", "action") == [
        ("1", "proposed_change.approve"), ("1", "proposed_change.edit"), ("2", "proposed_change.reject")]


def test_gates_and_workflow(spark):
    changes = spark.createDataFrame(
        [("1", "e1", "approved", "t", "j", "r1"), ("2", "e2", "approved", "t", "j", None), ("3", "e3", "pending", "t", "j", None), ("4", "e4", "approved", "t", "j", None)], CHANGES
    )
    outcomes = spark.createDataFrame([("1", 0), ("2", 1), ("4", 0)], "id string, errors int")
    published = spark.createDataFrame([("9", "e4"), ("1", "e1")], "id string, entity_id string")
    good, bad = review.collector_gate(changes, outcomes, published)
    assert rows(good, "id") == [("1",)]
    assert rows(bad, "id", "refusal") == [("2", "revalidation_failed"), ("3", "not_approved"), ("4", "already_published")]
    good, bad = review.reviewer_gate(changes.withColumn("delta", F.when(F.col("id") != "4", "d")), outcomes, spark.createDataFrame([("e2",)], "entity_id string"))
    assert rows(good, "id") == [] and dict(rows(bad, "id", "refusal"))["1"] == "not_in_production" and dict(rows(bad, "id", "refusal"))["4"] == "missing_input"
    table = spark.createDataFrame([("r1", "reviewer_workflow")], "id string, workflow_type string")
    assert dict(rows(review.with_workflow(changes, table), "id", "workflow_type")) == {
        "1": "reviewer_workflow", "2": "collector_workflow", "3": "collector_workflow", "4": "collector_workflow"}


def test_staging_twice_changes_nothing(spark):
    batch = spark.createDataFrame([("t1", 2), ("t1", 1), ("t2", 3)], "thread_id string, pos int")
    none = spark.createDataFrame([], "thread_id string")
    first = review.new_changes(none, batch)
    assert rows(first, "thread_id", "pos") == [("t1", 1), ("t2", 3)]
    assert review.new_changes(first, batch).count() == 0


def test_queue_commands_in_order(spark):
    queue = spark.createDataFrame(
        [("q", "queued", "n", "m", "u", None), ("f", "failed", "n", "m", "u", "boom"), ("r", "running", "n", "m", "u", None)],
        "id string, status string, name string, menu_url string, nutrition_url string, error_message string",
    )
    commands = spark.createDataFrame(
        [("q", 1, "edit", "a"), ("q", 2, "edit", "b"), ("q", 3, "delete", None), ("q", 4, "edit", "c"),
         ("f", 1, "edit", "x"), ("f", 2, "requeue", None), ("f", 3, "edit", "y"), ("f", 4, "requeue", None), ("r", 1, "delete", None), ("none", 1, "edit", "z")],
        "item_id string, seq long, command string, name string",
    ).withColumns({"menu_url": F.lit(None).cast("string"), "nutrition_url": F.lit(None).cast("string")})
    after, refused = workqueue.apply_commands(queue, commands)
    assert rows(after, "id", "status", "name", "error_message") == [("f", "queued", "y", None), ("r", "running", "n", None)]
    assert rows(refused, "item_id", "seq") == [("f", 1), ("f", 4), ("none", 1), ("q", 4), ("r", 1)]


def test_batch_dedup_keeps_inner_spaces(spark):
    items = spark.createDataFrame([(1, 0, "Joe's"), (1, 1, " joe's\t"), (1, 2, "Joe 's"), (2, 0, "JOE'S")], "batch_id int, pos int, name string")
    out = workqueue.enqueue_batch(items)
    assert rows(out, "batch_id", "pos", "status") == [(1, 0, "queued"), (1, 1, "skipped"), (1, 2, "queued"), (2, 0, "queued")]
    assert rows(workqueue.batch_report(out), "batch_id", "queued_count", "skipped_count") == [(1, 2, 1), (2, 1, 0)]


def test_candidates_and_resolution(spark):
    candidates = spark.createDataFrame(
        [("a", 0, "yelp.com/x", 0.9), ("a", 1, "good.com", 0.8), ("a", 2, "facebook.com", 0.1), ("b", 0, "x.com", 0.9), ("c", 0, "low.com", 0.5), ("c", 1, "also.com", 0.5)],
        "restaurant_id string, pos int, url string, provider_confidence double",
    ).withColumn("provider_name", F.lit("p"))
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "restaurant_id string")
    got = authority.resolve_sources(entities, candidates)
    assert rows(got, "restaurant_id", "status", "confidence", "resolved_url", "rejected_candidates") == [
        ("a", "verified", "high", "https://good.com/", 1), ("b", "rejected", None, None, 1),
        ("c", "needs_review", "medium", "https://low.com/", 0), ("d", "not_found", None, None, 0)]
    assert authority.verified_source_rows(got, F.current_timestamp()).count() == 1


def test_metrics_runs_and_mean(spark):
    updates = spark.createDataFrame([("r", 1, {"a": "1", "b": "1"}), ("r", 2, {"b": "2"})], "run_id string, seq int, metrics map<string,string>")
    assert runs.merge_metrics(updates).first().metrics == {"a": "1", "b": "2"}
    c = spark.createDataFrame([("x", 0.5), ("x", 1.0), ("y", 0.5), ("y", None)], "k string, c double")
    assert dict(rows(c.groupBy("k").agg(mapping.mean_if_all(F.col("c")).alias("m")), "k", "m")) == {"x": 0.75, "y": None}


def test_documents_in_parts_are_whole(spark):
    docs = spark.range(25).select(F.lit("s").alias("source"), F.col("id"), F.repeat(F.col("id").cast("string"), 15000).alias("text"))
    parts = mapping.assemble_documents(docs, "source", "id", "id", "text", part_positions=10).orderBy("part", "piece").collect()
    # Numbers of two digits make texts of 30 000 characters, which take two sections.
    assert [(p.part, p.piece, p.sections) for p in parts] == [(0, 0, 10), (1, 0, 10), (1, 1, 10), (2, 0, 5), (2, 1, 5)]
    found = {}
    for p in parts:
        for section in p.content.split(mapping.SECTION_SEPARATOR):
            head, _, text = section.partition("\n")
            assert len(text) <= 20_000
            found[head] = found.get(head, "") + text
    assert found == {f"[snapshot:{i}]": str(i) * 15000 for i in range(25)}


def test_sections_end_before_tags_and_lines(spark):
    text = "<li>one</li><li>two</li>\nthree " + "x" * 30
    row = spark.createDataFrame([(text,)], "t string").select(mapping.sections(F.col("t"), 16).alias("s")).first()
    assert "".join(row.s) == text and row.s[:3] == ["<li>one</li>", "<li>two</li>", "\nthree xxxxxxxxx"]


def test_mapped_dish(spark):
    none = {n: None for n in MACROS}
    row = ("r", 0, 0, " Soup ", None, None, {"serving_size": None, "macros": {**none, "calories": 12.3456}, "micronutrients": {n: None for n in MICRONUTRIENTS}},
           ["milk", "milk"], ["Salt ", " ", "Oil"], None, 9.99, None, None, [])
    out = mapping.map_dishes(spark.createDataFrame([row], EXTRACTED_DISH), F.lit("c"), ["run_id", "pos", "name"]).first()
    assert (out.name, str(out.nutrition.macros.calories), str(out.price), out.currency) == ("Soup", "12.346", "9.99", "USD")
    assert [i.name for i in out.ingredients] == ["Salt", "Oil"] and out.allergens == ["milk"]


def test_extraction_hook_runs_once_and_is_checked(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])

    def fn(pdf):
        return pd.DataFrame({"k": pdf["id"], "name": ["" if i % 2 else "ok" for i in pdf["id"]]})

    found = mapping.extract(spark.range(4), fn, schema, ["k"], Record((Rule("name", required=True, min_len=1),)))
    good, issues = found.rows, found.issues
    assert found.failures.count() == 0
    assert rows(good, "k") == [(0,), (2,)] and rows(issues, "k", "field_path") == [(1, "name"), (3, "name")]


def test_a_failing_document_is_a_row(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("price", T.DoubleType())])

    def fn(pdf):
        n = int(pdf["n"][0])
        if n == 3:
            raise RuntimeError("no answer")
        if n == 5:
            return pd.DataFrame({"pos": [0], "price": ["many"]})  # does not fit the schema
        if n == 6:
            return pd.DataFrame({"pos": [0]})  # a column is missing
        return pd.DataFrame({"pos": range(n % 3), "price": [1.5] * (n % 3)})

    docs = spark.range(9).select(F.when(F.col("id") < 8, F.floor(F.col("id") / 2)).alias("k"), F.col("id").alias("n"), F.lit(0).cast("long").alias("part"), (F.col("id") % 2).cast("int").alias("piece"))
    found = mapping.extract(docs, fn, schema, ["k", "pos"], Record((Rule("price", "decimal"),)))
    # Owners 1, 2 and 3 have a failed call; the null owner is one like any other.
    assert rows(found.rows, "k", "pos") == sorted([(0, 0), (None, 0), (None, 1)], key=repr)
    assert [r[0] for r in rows(found.failures, "k")] == [1, 2, 3]
    told = {r["k"]: r["message"] for r in found.failures.collect()}
    assert told[1] == "RuntimeError: no answer" and told[2].startswith("Arrow") and told[3].startswith("KeyError")


def test_profiles_and_menus(spark):
    base = spark.createDataFrame([("a", "old", "l", "c", ["x"])], "restaurant_id string, description string, logo_url string, cover_image_url string, cuisine_types array<string>")
    fresh = spark.createDataFrame([("a", "", "new", None, [])], base.schema)
    assert tuple(mapping.merge_profiles(base, fresh).first()) == ("a", "old", "new", "c", ["x"])
    live = spark.createDataFrame([("a", 1), ("b", 2)], "restaurant_id string, v int")
    new = spark.createDataFrame([("a", 9)], "restaurant_id string, v int")
    assert rows(mapping.merge_menus(live, new), "restaurant_id", "v") == [("a", 9), ("b", 2)]
    assert rows(mapping.merge_menus(live, new, keep_current=False), "restaurant_id", "v") == [("a", 9)]


def test_deep_pages_are_the_plain_ones(spark):
    df = spark.range(997).select((F.col("id") * 7 % 13).alias("a"), F.when(F.col("id") % 50 != 0, F.col("id") * 31 % 997).alias("b"), "id").repartition(7)
    order, plain = [("a", True), ("b", False), ("id", True)], [F.col("a").desc(), F.col("b").asc(), F.col("id").desc()]
    for number, size, parts in ((1, 20, 8), (2, 20, 8), (17, 33, 5), (50, 20, 8), (10, 100, 300), (11, 100, 3), (9, 100, 1)):
        want = [r.id for r in listing.page(df, plain, number, size).collect()]
        assert [r.id for r in listing.deep_page(df, order, number, size, parts).collect()] == want
    assert listing.deep_page(df.limit(0), order, 1, 20).count() == 0


def test_page_bounds(spark):
    import pytest

    df = spark.range(50).withColumn("created_at", F.lit(0))
    assert [r.id for r in listing.page(df, [F.col("id").desc()], 2, 20).collect()] == list(range(29, 9, -1))
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            listing.page(df, [F.col("id")], *bad)


def test_answers_are_checked_once_and_handed_on_together(spark):
    """Calls that fail, empty answers and rows outside the schema among others in one batch; whoever
    reads the rows does not check them again."""
    schema = T.StructType.fromDDL("k long, pos int, name string, tags array<string>, price double")

    def fn(pdf):
        k = int(pdf["k"][0])
        if k == 3:
            raise ValueError("no answer")
        if k == 5:
            return pd.DataFrame({"pos": ["x"], "name": ["a"], "tags": [[]], "price": [None]})
        n = k % 4
        if n == 0:
            return pd.DataFrame(columns=["pos", "name", "tags", "price"])
        return pd.DataFrame({"pos": range(n), "name": [None if k == 6 else f"n{k}"] * n, "tags": [["t"] * k] * n, "price": [None if k == 1 else 1.5] * n})

    found = mapping.extract(spark.range(12).withColumnRenamed("id", "k").coalesce(1), fn, schema, ["k", "pos"], Record((
        Rule("name", required=True, nullable=False, min_len=1), Rule("tags", "array"), Rule("price", "decimal"))))
    assert sorted((r.k, r.pos, r.name, len(r.tags), r.price) for r in found.rows.collect()) == [
        (k, p, f"n{k}", k, None if k == 1 else 1.5) for k in (1, 2, 7, 9, 10, 11) for p in range(k % 4)]
    assert sorted(r.k for r in found.issues.collect()) == [6, 6]
    assert {r.k: r.message.split(":")[0] for r in found.failures.collect()} == {3: "ValueError", 5: "ArrowInvalid"}
    assert "Generate" not in found.rows._jdf.queryExecution().optimizedPlan().toString()
