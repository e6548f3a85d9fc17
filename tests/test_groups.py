"""Hot groups must give the rows plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from menuloom.operators import groups


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        # One key holds a third of the rows; many rows share a time.
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 40)
        ts = rng.randrange(0, 300)
        data.append((key, ts, i, rng.choice("abc"), rng.randrange(1, 25), ts + rng.randrange(1, 30)))
    return spark.createDataFrame(data, "key long, ts long, id long, value string, busy long, release long").repartition(5).cache()


def collected(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


CASES = {
    "previous_value": lambda d: groups.previous_value(d, ["key"], ["ts", "id"], "value", "out"),
    "number_rows": lambda d: groups.number_rows(d, ["key"], ["ts", "id"], "out"),
    "hold_chain_fixed": lambda d: groups.hold_chain(d.withColumn("release", F.col("ts") + 20), ["key"], ["ts", "id"], "ts", "release"),
    "hold_chain_varied": lambda d: groups.hold_chain(d, ["key"], ["ts", "id"], "ts", "release"),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_equals_plain(spark, rows, name):
    plain = collected(CASES[name](rows))
    spark.conf.set("spark.menuloom.hotGroupRows", "5")
    try:
        hot = collected(CASES[name](rows))
    finally:
        spark.conf.unset("spark.menuloom.hotGroupRows")
    assert hot == plain
    assert len(plain) == 600


def test_hold_chain_against_one_by_one(rows):
    got = {r["id"]: (r["is_holder"], r["rank"], r["holder_ts"]) for r in CASES["hold_chain_varied"](rows).collect()}
    state = {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["id"])):
        until, start, n = state.get(r["key"], (None, None, 0))
        if until is None or r["ts"] >= until:
            until, start, n = r["release"], r["ts"], 0
        state[r["key"]] = (until, start, n + 1)
        assert got[r["id"]] == (n == 0, n + 1, start)


def one_by_one(rows):
    """(id: is_holder, rank, holder_ts), row after row."""
    state, out = {}, {}
    for key, ts, i, release in sorted(rows, key=lambda r: (r[1], r[2])):
        until, start, n = state.get(key, (None, None, 0))
        if until is None or ts >= until:
            until, start, n = release, ts, 0
        state[key] = (until, start, n + 1)
        out[i] = (n == 0, n + 1, start)
    return out


HUGE = 1 << 55  # such times are rounded as doubles
HOLDS = {
    "evenly spaced": [(None, HUGE + 10 * i, i, HUGE + 10 * i + 65) for i in range(700)],
    "over many chunks": [("k", i, i, i + (301 if i % 97 == 0 else 1)) for i in range(700)],
    "one hold over all": [("k", i // 3, i, i // 3 + 10_000) for i in range(300)] + [("j", i, 1000 + i, i + 2) for i in range(100)],
    "all at one time": [("k", 5, i, 5 + i % 3) for i in range(200)] + [("k", 6, 500 + i, 9) for i in range(20)],
    "many releases in one chunk": [("k", i, i, 5000 + i % 50) for i in range(400)] + [("k", 5000 + i, 1000 + i, 5001 + i) for i in range(60)],
}


@pytest.mark.parametrize("name", HOLDS)
def test_hot_holds_against_one_by_one(spark, hot_groups, name):
    rows = [(*r[:3], r[3]) for r in HOLDS[name]]
    frame = spark.createDataFrame(rows, "key string, ts long, id long, release long").repartition(5)
    got = groups.hold_chain(frame, ["key"], ["ts", "id"], "ts", "release").collect()
    assert {r["id"]: (r["is_holder"], r["rank"], r["holder_ts"]) for r in got} == one_by_one(rows)


def test_join_group_facts_hot_equals_plain(spark, rows, hot_groups):
    facts = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = collected(groups.join_group_facts(rows, facts, ["key"], "n"))
    spark.conf.set("spark.menuloom.hotGroupRows", "100000")
    assert hot == collected(groups.join_group_facts(rows, facts, ["key"], "n"))
    assert len(hot) == 600


def test_first_rows_and_top_of_group(rows):
    flagged = groups.first_rows(rows, ["key"], "id", "first").filter("first").collect()
    want = {}
    for r in rows.collect():
        want[r["key"]] = min(want.get(r["key"], 10**9), r["id"])
    assert {r["key"]: r["id"] for r in flagged} == want
    top = groups.top_of_group(rows, ["key"], [F.col("ts"), F.col("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["id"])):
        by_key.setdefault(r["key"], []).append(r["id"])
    assert sorted(r["id"] for r in top.collect()) == sorted(i for ids in by_key.values() for i in ids[:3])


def test_repartitioning_changes_nothing(rows, hot_groups):
    for case in CASES.values():
        assert collected(case(rows.repartition(3))) == collected(case(rows.repartition(7, "value")))


def test_chunks_do_not_follow_the_limit_for_hot_keys(spark, rows, hot_groups):
    chunked = groups.with_chunks(rows, ["key"], ["ts", "id"])
    assert chunked.select(groups.CHUNK).distinct().count() <= 8


@pytest.mark.parametrize("name", HOLDS)
def test_small_chunks_and_batches(spark, hot_groups, name):
    """Holds go on over chunks and over Python's batches."""
    few = {"spark.menuloom.chunkRows": "7", "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
    frame = spark.createDataFrame(HOLDS[name], "key string, ts long, id long, release long").repartition(5)
    for conf, value in few.items():
        spark.conf.set(conf, value)
    try:
        hot = groups.hold_chain(frame, ["key"], ["ts", "id"], "ts", "release").collect()
        spark.conf.set("spark.menuloom.hotGroupRows", "100000")
        plain = groups.hold_chain(frame, ["key"], ["ts", "id"], "ts", "release").collect()
    finally:
        for conf in few:
            spark.conf.unset(conf)
    for got in (hot, plain):
        assert {r["id"]: (r["is_holder"], r["rank"], r["holder_ts"]) for r in got} == one_by_one(HOLDS[name])


def test_a_hold_chain_never_hands_python_a_whole_group(spark, rows):
    plan = groups.hold_chain(rows, ["key"], ["ts", "id"], "ts", "release")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_chunks_are_dealt_to_as_many_tasks(spark, rows, hot_groups):
    """A task sorts a few chunks, however few shuffle partitions there are."""
    spark.conf.set("spark.menuloom.chunkRows", "20")
    try:
        numbered = groups.number_rows(rows, ["key"], ["ts", "id"], "no")
        assert "REPARTITION_BY_NUM" in numbered._jdf.queryExecution().executedPlan().toString()
        assert numbered.groupBy("key", "no").count().where("count > 1").isEmpty()
    finally:
        spark.conf.unset("spark.menuloom.chunkRows")


def test_rows_without_a_time_change_no_hold(spark):
    """They come last and take no hold, and the holds of the other rows are found to the end."""
    timed = [("k", 10 * i, i, 10 * i + 25) for i in range(64)]
    rows = [*timed, *[("k", None, 100 + i, None) for i in range(6)]]
    got = groups.hold_chain(spark.createDataFrame(rows, "key string, ts long, id long, release long"), ["key"], ["ts", "id"], "ts", "release").collect()
    want = one_by_one(timed)
    assert {r["id"]: (r["is_holder"], r["rank"], r["holder_ts"]) for r in got if r["id"] < 100} == want
    assert not any(r["is_holder"] for r in got if r["id"] >= 100)
