"""Patches of whole catalogs: moves, removals and what goes with them."""

import random

from pyspark.sql import functions as F

from menuloom.operators import catalog
from menuloom.plans import decide

SCHEMAS = {
    "locations": "entity_id string, location_id long, city string",
    "menus": "entity_id string, menu_id long, name string",
    "categories": "entity_id string, category_id long, name string, parent_id long, menu_id long",
    "dishes": "entity_id string, dish_id long, category_id long, price double",
}


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def contents(tables):
    return {name: sorted(map(tuple, df.collect()), key=repr) for name, df in tables.items()}


LIVE = dict(
    locations=[("r", 1, "Bonn"), ("r", 2, "Ulm"), ("s", 1, "Bonn")],
    menus=[("r", 1, "day"), ("r", 2, "night"), ("s", 1, "day")],
    categories=[("r", 1, "soup", None, 1), ("r", 2, "hot", 1, None), ("r", 3, "deep", 2, None), ("r", 4, "kept", 2, None), ("r", 5, "wine", None, 2), ("r", 6, "under kept", 4, None), ("s", 1, "soup", None, 1)],
    dishes=[("r", 10 + c, c, 1.0) for c in range(1, 7)] + [("s", 11, 1, 1.0), ("r", 30, 99, 1.0)],
)
#: The day menu goes, category 4 moves under the wine, a city changes, a location is added.
TARGET = dict(
    locations=[("r", 1, "Kiel"), ("r", 2, "Ulm"), ("r", 3, "Jena"), ("s", 1, "Bonn")],
    menus=[("r", 2, "night"), ("s", 1, "day")],
    categories=[("r", 1, "soup", None, 1), ("r", 2, "hot", 1, None), ("r", 3, "deep", 2, None), ("r", 4, "kept", 5, None), ("r", 5, "wine", None, 2), ("r", 6, "under kept", 4, None), ("s", 1, "soup", None, 1)],
    dishes=LIVE["dishes"],
)
AFTER = {
    "locations": sorted(TARGET["locations"], key=repr), "menus": sorted(TARGET["menus"], key=repr),
    "categories": sorted((c for c in TARGET["categories"] if c[0] == "s" or c[1] > 3), key=repr),
    "dishes": sorted((d for d in LIVE["dishes"] if d[0] == "s" or d[2] > 3), key=repr),
}


def test_moves_outlive_removals(spark):
    live, target = tables(spark, **LIVE), tables(spark, **TARGET)
    changes = catalog.catalog_diff(live, target)
    moved = changes["categories"].collect()
    assert [(r.category_id, r.field, r.old_value, r.new_value) for r in moved] == [(4, "parent_id", "2", "5")]
    out = catalog.apply_catalog_delta(live, target, changes)
    assert contents(out.tables) == AFTER
    assert sorted((r.table, r.id) for r in out.cascaded.collect()) == [("categories", "1"), ("categories", "2"), ("categories", "3"), ("dishes", "11"), ("dishes", "12"), ("dishes", "13")]


def test_no_change_and_empty_tables(spark):
    live = tables(spark, **LIVE)
    out = catalog.apply_catalog_delta(live, live, catalog.catalog_diff(live, live))
    assert contents(out.tables) == contents(live) and out.cascaded.count() == 0
    none = tables(spark)
    assert all(df.isEmpty() for df in catalog.apply_catalog_delta(none, live, catalog.catalog_diff(none, none)).tables.values())
    gone = catalog.apply_catalog_delta(live, none, catalog.catalog_diff(live, none))
    assert all(df.isEmpty() for df in gone.tables.values())


def test_rows_below(spark):
    """Random forests with cycles, missing parents, null entities and one long chain."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), i, rng.choice([None, rng.randint(0, 260)])) for i in range(250)]
    rows += [("chain", i, i - 1) for i in range(1, 300)] + [("ring", i, i % 5 + 1) for i in range(1, 6)]
    start = [r[:2] for r in rows if r[0] in ("a", None) and rng.random() < 0.05] + [("chain", 40), ("ring", 2)]
    up = {(e, i): (e, p) for e, i, p in rows}

    def hit(node):
        seen = set()
        while node in up and node not in seen:
            if node in start:
                return True
            seen.add(node)
            node = up[node]
        return False

    df = spark.createDataFrame(rows, "entity_id string, id long, up long")
    got = catalog.below(df, "id", "up", spark.createDataFrame(start, "entity_id string, id long"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {n for n in up if hit(n)}
    assert catalog.below(df, "id", "up", got.limit(0)).count() == 0


def test_a_published_review_patches_all_tables(spark):
    live, target = tables(spark, **LIVE), tables(spark, **TARGET)
    both = catalog.catalog_diff(live, target)
    changes = spark.createDataFrame(
        [(1, "r", 7, "{}", "pending", "t1"), (2, "r", 7, "{}", "pending", "t2")],
        "id long, entity_id string, agent_run_id long, structured_json string, status string, thread_id string")
    runs = spark.createDataFrame([(7, "reviewer_workflow")], "id long, workflow_type string")
    no_errors = spark.createDataFrame([(1, 0), (2, 0)], "id long, errors long")

    def publish(action):
        decisions = spark.createDataFrame(
            [(1, 1, action, None, "u", None, "2026-01-01")],
            "proposed_change_id long, seq long, action string, edited_structured_json string, reviewer_user_id string, reason string, decided_at string")
        # The cities belong to another change, which nobody has decided on.
        lines = {name: d.withColumn("change_id", F.lit(2 if name == "locations" else 1).cast("long")) for name, d in both.items()}
        return decide.decide_and_publish(
            changes, decisions, runs, no_errors, live, target, lines.pop("dishes"), ["dish_id"], table_deltas=lines)

    out = publish("approve")
    assert contents(out.tables) == {**AFTER, "locations": sorted(LIVE["locations"], key=repr)}
    assert [r.id for r in out.published.collect()] == [1]
    assert contents(publish("reject").tables) == contents(live)


def test_publishing_reads_decisions_outcomes_and_deltas_once(spark):
    """Whatever is asked of the result, no input of the decisions is worked out again."""
    from pyspark.sql import types as T

    dishes = tables(spark, dishes=[("r", 1, 1, 1.0), ("r", 2, 1, 2.0), ("s", 3, 1, 1.0)])["dishes"]
    target = tables(spark, dishes=[("r", 1, 1, 5.0), ("r", 2, 1, 2.0), ("s", 3, 1, 7.0)])["dishes"]
    changes = spark.createDataFrame(
        [(1, "r", 7, "{}", "pending", "t1"), (2, "s", 7, "{}", "pending", "t2")],
        "id long, entity_id string, agent_run_id long, structured_json string, status string, thread_id string")
    runs = spark.createDataFrame([(7, "reviewer_workflow")], "id long, workflow_type string")
    seen = {name: spark.sparkContext.accumulator(0) for name in ("decisions", "outcomes", "delta")}

    def counted(df, name, column):
        counter = seen[name]

        def count(value):
            counter.add(1)
            return value

        return df.withColumn(column, F.udf(count, df.schema[column].dataType).asNondeterministic()(column))

    decisions = spark.createDataFrame(
        [(1, 1, "approve", None, "u", None, "d"), (1, 2, "reject", None, "u", None, "d"), (2, None, "reject", None, "u", None, "d")],
        T.StructType.fromDDL("proposed_change_id long, seq long, action string, edited_structured_json string, reviewer_user_id string, reason string, decided_at string"))
    outcomes = spark.createDataFrame([(1, 0), (2, 0)], "id long, errors long")
    delta = spark.createDataFrame([("r", 1, "changed", 1), ("s", 3, "changed", 2)], "entity_id string, dish_id long, op string, change_id long")
    out = decide.decide_and_publish(
        changes, counted(decisions, "decisions", "action"), runs, counted(outcomes, "outcomes", "errors"), {"dishes": dishes}, {"dishes": target},
        counted(delta, "delta", "op"), ["dish_id"])
    assert sorted((r.id, r.status) for r in out.changes.collect()) == [(1, "published"), (2, "rejected")]
    assert sorted((r.entity_id, r.dish_id, r.price) for r in out.dishes.collect()) == [("r", 1, 5.0), ("r", 2, 2.0), ("s", 3, 1.0)]
    assert [r.status for r in out.runs.collect()] == ["succeeded"]
    assert seen["decisions"].value <= 3 and seen["outcomes"].value <= 2 and seen["delta"].value <= 2, seen
