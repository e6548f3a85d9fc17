"""Leaf-level differences against a plain walk, null keys, repeated keys and identities."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from menuloom.operators import conform, delta, leaves, report, rules
from menuloom.schema import Record, Rule
from menuloom.sources import upload



def walk(value, path, owner):
    """Leaves of a plain value: (path, owner, kind, text)."""
    if isinstance(value, dict):
        for name, v in value.items():
            yield from walk(v, f"{path}.{name}", owner)
    elif isinstance(value, list) and value and isinstance(value[0], dict) and ({"id", "name"} & value[0].keys()):
        known = "id" if "id" in value[0] else "name"
        for e in value:
            at = f"{path}[{known}={str(e[known]).replace('[', chr(92) + '[').replace(']', chr(92) + ']')}]"
            yield at, owner, "item", None
            yield from walk({n: v for n, v in e.items() if n != known}, at, at)
    elif isinstance(value, list):
        for e in value:
            yield f"{path}[]", owner, "element", json.dumps(e, separators=(",", ":")) if isinstance(e, dict) else e
    else:
        yield path, owner, "field", value


def plain_diff(old, new):
    before, after = (Counter(l for n, v in x.items() for l in walk(v, n, "")) for x in (old, new))
    change = {l: after[l] - before[l] for l in before | after if after[l] != before[l]}
    lone = {p for (p, o, kind, _) in change if kind == "item" and (not before[p, o, kind, None] or not after[p, o, kind, None])}
    out = []
    rest = {l: d for l, d in change.items() if l[1] not in lone}
    paths = {}
    for (p, o, kind, v), d in rest.items():
        if kind == "item":
            if p in lone:
                out.append((p, "removed" if d < 0 else "added", None, None, abs(d)))
        else:
            paths.setdefault((p, kind), []).append((v, d))
    for (p, kind), found in paths.items():
        if kind == "field" and sorted(d for _, d in found) == [-1, 1]:
            (was, _), (now, _) = sorted(found, key=lambda x: x[1])
            out.append((p, "changed", was, now, 1))
        else:
            out += [(p, "removed" if d < 0 else "added", v if d < 0 else None, v if d > 0 else None, abs(d)) for v, d in found]
    return out


def record(rng):
    dish = lambda: {"name": rng.choice(["Soup", "Tea", "a].b[c", "Pie"]), "price": rng.choice(["1.00", "2.50", None]), "allergens": rng.choices(["milk", "soy"], k=rng.randrange(3))}
    menu = lambda i: {"id": i, "title": rng.choice("xy"), "dishes": [dish() for _ in range(rng.randrange(4))], "links": [{"url": rng.choice("uv")} for _ in range(rng.randrange(3))]}
    return {
        "name": rng.choice(["n", None]), "size": {"g": None, "note": {"text": rng.choice(["t", "s", None])}}, "tags": rng.choices("abc", k=rng.randrange(4)),
        "menus": [menu(i) for i in rng.sample(range(4), rng.randrange(4))],
    }


def test_leaf_diff_is_the_plain_walk(spark):
    rng = random.Random(1)
    both = [(record(rng), record(rng)) for _ in range(60)]
    # The same record with its lists in another order has no difference.
    both += [(r, {**r, "tags": r["tags"][::-1], "menus": r["menus"][::-1]}) for r, _ in both[:10]]
    kind = "k int, doc struct<name: string, size: struct<g: double, note: struct<text: string>>, tags: array<string>, menus: array<struct<id: int, title: string, dishes: array<struct<name: string, price: string, allergens: array<string>>>, links: array<struct<url: string>>>>>"
    frames = [spark.createDataFrame([(i, json.dumps(p[side])) for i, p in enumerate(both)], "k int, j string").select("k", F.from_json("j", kind.split("doc ", 1)[1]).alias("d")).select("k", "d.*").repartition(3) for side in (0, 1)]
    found = leaves.leaf_diff(*frames, ["k"]).collect()
    is_item = lambda p: p.endswith("]") and not p.endswith("[]")
    have = sorted(repr((r["k"], r["path"], r["op"], None if is_item(r["path"]) else r["old_value"], None if is_item(r["path"]) else r["new_value"], r["copies"])) for r in found)
    want = sorted(repr((i, *line)) for i, (a, b) in enumerate(both) for line in plain_diff(a, b))
    assert have == want and len(want) > 200
    assert not [r for r in found if r["k"] >= 60]
    one = next(r for r in found if is_item(r["path"]) and r["op"] == "removed")
    assert json.loads(one["old_value"])


def test_leaf_diff_of_whole_rows_maps_and_null_keys(spark):
    kind = "k int, v map<string,int>, t array<string>, id int"
    current = spark.createDataFrame([(1, {"a": 1, "b": 2}, None, 5), (None, {"a": 1}, ["x"], 6), (3, None, ["x", "x"], 7)], kind)
    target = spark.createDataFrame([(1, {"b": 3, "c": 4}, [], 8), (None, {"a": 1}, ["x"], 9), (4, None, None, 9)], kind)
    found = {(r["k"], r["path"], r["op"], r["old_value"], r["new_value"]) for r in leaves.leaf_diff(current, target, ["k"]).collect()}
    assert found == {
        (1, "v[id=a]", "removed", '{"id":"a","value":1}', None), (1, "v[id=c]", "added", None, '{"id":"c","value":4}'), (1, "v[id=b].value", "changed", "2", "3"),
        (3, None, "removed", '{"t":["x","x"]}', None), (4, None, "added", None, "{}"),
    }
    assert leaves.leaf_diff(current, current, ["k"]).count() == 0
    assert leaves.leaf_diff(current.limit(0), target.limit(0), ["k"]).count() == 0


NULLS = [(None, "x", 1), (None, None, 2), ("a", None, 3), ("a", "x", 4)]


def test_null_keys_are_keys(spark):
    current = spark.createDataFrame(NULLS, "a string, b string, v int")
    target = current.withColumn("v", F.when(F.col("v") == 2, 20).otherwise(F.col("v")))
    keys = ["a", "b"]
    assert delta.table_diff(current, current, keys).count() == 0
    found = delta.table_diff(current, target, keys)
    assert [tuple(r) for r in found.collect()] == [(None, None, "v", "changed", "2", "20")]
    patched = delta.patch_rows(current, target, found, keys)
    assert delta.table_diff(patched, target, keys).count() == 0 and patched.count() == 4
    shorter = target.filter("a IS NOT NULL")
    gone = delta.table_diff(current, shorter, keys)
    assert gone.count() == 2 and delta.patch_rows(current, shorter, gone, keys).count() == 2
    fields = delta.patch_fields(current, target, found, keys, ["v"])
    assert sorted(r["v"] for r in fields.collect()) == [1, 3, 4, 20]
    refs = current.select(*keys, F.array(F.lit("s")).alias("source_snapshot_ids"))
    assert delta.with_provenance(found, refs, refs.select("a", "source_snapshot_ids").limit(0), keys, "a").first()["source_snapshot_ids"] == ["s"]


def test_repeated_keys_are_told(spark):
    one = spark.createDataFrame(NULLS, "a string, b string, v int")
    twice = one.union(one.filter("v = 2"))
    assert [tuple(r) for r in delta.repeated_keys(twice, one, ["a", "b"]).collect()] == [(None, None, 2, 1)]
    assert delta.repeated_keys(one, one, ["a", "b"]).count() == 0


def test_records_without_a_key_are_judged(spark):
    records = spark.createDataFrame([(None,), ("a",)], "k string")
    issues = spark.createDataFrame([(None, rules.ERROR)], "k string, severity string")
    assert {r["k"]: (r["errors"], r["is_valid"]) for r in report.outcome_per_record(records, issues, ["k"]).collect()} == {None: (1, False), "a": (0, True)}
    docs = spark.createDataFrame([(None, '{"n": 5}'), ("a", '{"n": "x"}')], "k string, j string")
    found = conform.flat_schema_issues(docs, ["k"], "j", Record((Rule("n"),)))
    assert [r["k"] for r in conform.conforming(docs, found, ["k"]).collect()] == ["a"]
    body = json.dumps([{"name": "", "menu_url": "u", "nutrition_url": "u"}, {"name": "N", "menu_url": "u", "nutrition_url": "u"}])
    good, errors = upload.upload_items(spark.createDataFrame([(None, body)], "batch_id string, body string"))
    assert [r["name"] for r in good.collect()] == ["N"] and errors.count() == 1


def test_duplicates_of_a_null_scope(spark):
    dishes = spark.createDataFrame([(None, "Soup"), (None, "soup "), ("m", "Soup"), ("m", None), ("m", None)], "menu string, name string")
    assert sorted(r["name"] for r in rules.duplicate_members(dishes, ["menu"]).collect()) == ["Soup", "soup "]


def test_leaves_are_counted_without_a_shuffle_of_them(spark):
    """Whole rows are dealt by key; their leaves stay where they are, and keys may be null."""
    kind = "k long, _old struct<tags: array<string>, items: array<struct<id: long, n: long>>>, _new struct<tags: array<string>, items: array<struct<id: long, n: long>>>"
    both = spark.createDataFrame([(1, (["a", "a"], [(1, 1), (2, 2)]), (["a", "b"], [(2, 3)])), (None, (["x"], []), (["x"], []))], kind)
    counted = leaves.leaf_counts(both, ["k"], ["tags", "items"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange"), plan
    found = {(r.k, r.path, r.value): (r.d, r.n_old, r.n_new) for r in counted.collect()}
    assert found == {
        (1, "tags[]", "a"): (-1, 2, 1), (1, "tags[]", "b"): (1, 0, 1), (1, "items[id=1]", None): (-1, 1, 0), (1, "items[id=1].n", "1"): (-1, 1, 0),
        (1, "items[id=2]", None): (0, 1, 1), (1, "items[id=2].n", "2"): (-1, 1, 0), (1, "items[id=2].n", "3"): (1, 0, 1), (None, "tags[]", "x"): (0, 1, 1),
    }
