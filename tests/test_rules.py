import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from menuloom.operators import conform, corrections, report, rules, tree
from menuloom.operators.groups import totals_before
from menuloom.schema import DISH_RECORD, MACROS, MICRONUTRIENTS, NUTRITION, RESTAURANT_RECORD, Record, Rule
from menuloom.suite import validation
from menuloom.suite.base import Tables, dishes as derived_dishes

COLUMNS = (
    "restaurant_id long, menu_pos int, dish_id long, path string, name string, description string, nutrition "
    + NUTRITION.simpleString() + ", allergens array<string>, ingredients array<struct<name:string,is_optional:boolean>>, "
    "price decimal(10,2), currency string"
)


def dish(n, name="Margherita Pizza", macros=None, serving="1", price="12.99", currency="USD", ingredients=(), allergens=(), description=None, menu=0):
    values = {m: None for m in MACROS}
    values.update({k: Decimal(str(v)) for k, v in (macros or {"calories": 290, "protein_g": 20, "carbohydrates_g": 30, "fat_g": 10}).items()})
    nutrition = {"serving_size": serving, "macros": values, "micronutrients": {m: None for m in MICRONUTRIENTS}}
    return (1, menu, n, f"menus[{menu}].categories[0].dishes[{n}]", name, description, nutrition, list(allergens),
            [(i, False) for i in ingredients], None if price is None else Decimal(price), currency)


def codes(spark, *dishes):
    found = rules.dish_issues(spark.createDataFrame(list(dishes), COLUMNS), ["dish_id"]).collect()
    return sorted((r.dish_id, r.code) for r in found)


CASES = [
    (dict(), []),
    (dict(macros={"calories": 2000, "protein_g": 20, "carbohydrates_g": 30, "fat_g": 10}), ["atwater_mismatch"]),
    # expected 290: tolerance 101.5, strict
    (dict(macros={"calories": "391.5", "protein_g": 20, "carbohydrates_g": 30, "fat_g": 10}), []),
    (dict(macros={"calories": "391.501", "protein_g": 20, "carbohydrates_g": 30, "fat_g": 10}), ["atwater_mismatch"]),
    (dict(macros={"calories": 50, "protein_g": 0, "carbohydrates_g": 0, "fat_g": 0}), []),
    (dict(macros={"calories": 4999}), []),
    (dict(macros={"calories": 5000}), []),
    (dict(macros={"calories": "5000.001"}), ["implausible_calories"]),
    (dict(macros={"calories": 1, "sodium_mg": 10001}), ["implausible_sodium"]),
    (dict(serving=""), ["missing_serving_size"]),
    (dict(serving=None), ["missing_serving_size"]),
    (dict(macros={"sodium_mg": 5}, serving=None), ["missing_nutrition"]),
    (dict(price=None), ["missing_price"]),
    (dict(price="0"), ["zero_price"]),
    (dict(price="500"), []),
    (dict(price="500.01"), ["implausible_price"]),
    (dict(currency="US$"), ["malformed_currency_code"]),
    (dict(currency="usd"), ["lowercase_currency_code"]),
    (dict(macros={"fat_g": 1, "saturated_fat_g": 2, "trans_fat_g": 3, "carbohydrates_g": 1, "sugar_g": 2, "fiber_g": 3}),
     ["fiber_exceeds_total_carbohydrates", "saturated_fat_exceeds_total_fat", "sugar_exceeds_total_carbohydrates", "trans_fat_exceeds_total_fat"]),
    (dict(ingredients=["Whole MILK", "Wheat Flour", "salt"], allergens=["milk"]), ["possible_undeclared_allergen"]),
    (dict(ingredients=["buttercream", "eggnog"]), ["possible_undeclared_allergen"] * 2),
]


def test_single_row_rules(spark):
    rows = [dish(i, **kwargs) for i, (kwargs, _) in enumerate(CASES)]
    assert codes(spark, *rows) == sorted((i, c) for i, (_, want) in enumerate(CASES) for c in want)


def test_duplicates_per_menu_and_hot(spark, hot_groups):
    rows = [dish(i, "Pizza  " if i % 2 else "pizza") for i in range(9)] + [dish(20, "Pizza", menu=1), dish(21, "Soup"), dish(22, " SOUP ")]
    df = spark.createDataFrame(rows, COLUMNS)
    found = rules.duplicate_issues(df, ["dish_id"], ["restaurant_id", "menu_pos"])
    assert sorted(r.dish_id for r in found.collect()) == [*range(9), 21, 22]
    whole = rules.duplicate_issues(df, ["dish_id"], ["restaurant_id"])
    assert sorted(r.dish_id for r in whole.collect()) == [*range(9), 20, 21, 22]


def test_corrections_log_and_idempotence(spark):
    df = spark.createDataFrame([dish(1, currency="usd", description="a  b\u00a0", ingredients=["Salt", "salt ", "Oil"]), dish(2)], COLUMNS)
    corrected = corrections.correct_dishes(df)
    log = {r.field_path.rsplit(".", 1)[1]: (r.old_value, r.new_value) for r in corrections.correction_log(corrected, ["dish_id"]).collect()}
    assert log == {"currency": ("usd", "USD"), "description": ("a  b\u00a0", "a b"), "ingredients": ('["Salt","salt ","Oil"]', '["Salt","Oil"]')}
    fixed = corrections.corrected_only(corrected)
    assert corrections.correction_log(corrections.correct_dishes(fixed), ["dish_id"]).count() == 0
    for c in ("price", "allergens", "name", "nutrition"):
        assert [r[0] for r in fixed.orderBy("dish_id").select(c).collect()] == [r[0] for r in df.orderBy("dish_id").select(c).collect()]


def test_full_run_and_outcome(spark):
    df = spark.createDataFrame([dish(1, currency="usd"), dish(2, price="900")], COLUMNS)
    restaurants = spark.createDataFrame([(1,), (2,), (3,)], "restaurant_id long")
    menus = spark.createDataFrame([(1,), (3,)], "restaurant_id long")
    out = report.run_rules(restaurants, restaurants.limit(0), menus, df)
    outcome = {r.restaurant_id: (r.errors, r.warnings, r.is_valid, r.corrected_fields) for r in report.outcome_per_record(restaurants, out.issues, ["restaurant_id"], out.log).collect()}
    # two dishes share a name; no lower-case currency is left to warn about
    assert outcome == {1: (1, 3, False, 1), 2: (1, 1, False, 0), 3: (1, 1, False, 0)}


def test_schema_violations(spark):
    good = {"name": "x", "category_id": "c", "nutrition": {"macros": {"calories": "12.5"}}, "allergens": ["milk"], "price": 3}
    cases = {
        "good": good,
        "missing": {k: v for k, v in good.items() if k != "name"},
        "extra": {**good, "nutrition": {"macros": {"caffeine": 1}}},
        "blank": {**good, "name": " \u00a0"},
        "negative": {**good, "price": -1},
        "enum": {**good, "review_state": "later"},
        "allergen": {**good, "allergens": ["milk", "sand"]},
        "type": {**good, "description": 5},
        "null": {**good, "currency": None},
        "long": {**good, "description": "x" * 2001},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("root", "[]"), ("broken", "{")], "k string, j string")
    got = sorted((r.k, r.field_path) for r in conform.schema_issues(rows, ["k"], "j", DISH_RECORD).collect())
    assert got == sorted([
        ("missing", "name"), ("extra", "nutrition.macros.caffeine"), ("blank", "name"), ("negative", "price"), ("enum", "review_state"),
        ("allergen", "allergens"), ("type", "description"), ("null", "currency"), ("long", "description"), ("root", "<root>"), ("broken", "<root>"),
    ])


def test_nested_records_and_depth(spark):
    leaf = {"name": "leaf", "dishes": [{"name": "", "category_id": "c"}]}
    tree_json = leaf
    for i in range(2):
        tree_json = {"name": f"level {i}", "children": [tree_json]}
    deep = {"name": ""}
    for i in range(10):
        deep = {"name": "d", "children": [deep]}
    rows = spark.createDataFrame(
        [("a", json.dumps({"name": "r", "menus": [{"categories": [tree_json]}]})), ("b", json.dumps({"name": "r", "menus": [{"categories": [deep]}]}))],
        "k string, j string",
    )
    got = {(r.k, r.field_path) for r in conform.schema_issues(rows, ["k"], "j", RESTAURANT_RECORD).collect()}
    assert ("a", "menus.0.categories.0.children.0.children.0.dishes.0.name") in got
    assert {p for k, p in got if k == "b" and p.endswith(".name")} == {"menus.0.categories.0" + ".children.0" * 10 + ".name"}


def test_records_are_cut_out_of_texts_as_they_stand():
    decode, below = conform._decoder(), [{"a": 1}, {"a": 1, "b": 2}, {}]
    text = ' { "x" : [1, {"a": [9]}] , "a" : [ {"n":1.50 ,"b":[ 7 , {"q":"]}\\""}, [] ],"a":[{}]} , null ] } '
    assert conform.nested_records(decode, text, below) == [
        (0, "", text), (1, "a.0", '{"n":1.50 ,"b":[ 7 , {"q":"]}\\""}, [] ],"a":[{}]}'), (1, "a.1", "null"),
        (2, "a.0.b.0", "7"), (2, "a.0.b.1", '{"q":"]}\\""}'), (2, "a.0.b.2", "[]"), (1, "a.0.a.0", "{}"),
    ]
    for bad in (None, "", "{", '{"a": [NaN]}', '{"a": [{}]} x', '{"a": 5}', "[{}]", '{"a": [{}], "a": [{}]}', '{"a": [],}', "[" * 100_000):
        assert conform.nested_records(decode, bad, below) == [(0, "", bad)]


def test_words_inside_names(spark):
    import random

    rng = random.Random(4)
    words = [("".join(rng.choices("abé", k=rng.randrange(0, 5))), f"v{rng.randrange(4)}") for _ in range(60)] + [(None, "n"), ("ab", None)]
    names = [(i if i % 9 else None, None if i % 17 == 0 else "".join(rng.choices("ABabéx ", k=rng.randrange(12)))) for i in range(200)]
    table, rows = spark.createDataFrame(words, "word string, allergen string"), spark.createDataFrame(names, "k int, name string")
    want = sorted({(k, v) for k, n in names if n is not None for w, v in words if w and w in n.lower()}, key=repr)
    for shard in (7, 10_000):
        got = rules.words_inside(rows.withColumn("name", F.lower("name")), table, ["k"], "name", "word", "allergen", shard_chars=shard)
        assert sorted({(r.k, r.allergen) for r in got.collect()}, key=repr) == want
    declared = spark.createDataFrame([(None, "v1"), (5, "v2")], "k int, allergen string")
    left = rules.undeclared_by_word_table(rows, declared, table, ["k"]).collect()
    assert sorted(((r.k, r.allergen) for r in left), key=repr) == [x for x in want if x not in ((None, "v1"), (5, "v2"))]
    assert rules.undeclared_by_word_table(rows, declared, table.limit(0), ["k"]).count() == 0


def test_long_chains_and_cycles(spark):
    nodes = [(str(i), str(i - 1) if i else None) for i in range(100)] + [("p", "q"), ("q", "p"), ("below", "p")]
    good, bad = tree.category_paths(spark.createDataFrame(nodes, "id string, parent string"), "id", "parent", F.col("id"))
    assert {r.id: r.depth for r in good.collect()} == {str(i): i + 1 for i in range(100)}
    assert {r.id for r in bad.collect()} == {"p", "q", "below"}


def test_numbers_are_finite_and_boolean_words(spark):
    record = Record((Rule("n", "decimal"), Rule("b", "bool")))
    rows = spark.createDataFrame([(i, json.dumps({"n": n, "b": b})) for i, (n, b) in enumerate([("NaN", True), ("Infinity", "y"), ("1.5", "T"), (2, "f"), (3, "maybe")])], "k int, j string")
    got = {(r.k, r.field_path) for r in conform.schema_issues(rows, ["k"], "j", record).collect()}
    assert got == {(0, "n"), (1, "n"), (4, "b")}


def test_gate(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "b")], "id int, x string, y string")
    passed, errors = conform.gate(rows, "publish", ["x", "y"])
    assert [r.id for r in passed.collect()] == [2]
    assert [(r.id, r.error_message) for r in errors.collect()] == [(1, "y required before publish")]


def test_first_messages_are_cut_before_the_shuffle(spark):
    issues = spark.range(40).select(F.lit(1).alias("r"), F.col("id"), F.lit("error").alias("severity"), F.col("id").cast("string").alias("message"))
    assert report.first_messages(issues, ["r"], ["id"]).first().first_errors == "0; 1; 2; 3; 4"


def test_category_paths_cycles_and_orphans(spark):
    nodes = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("o", "gone")]
    good, bad = tree.category_paths(spark.createDataFrame(nodes, "id string, parent string"), "id", "parent", F.col("id"))
    assert {r.id: (r.path, r.depth) for r in good.collect()} == {"a": ("a", 1), "b": ("a.b", 2), "c": ("a.b.c", 3), "d": ("a.b.c.d", 4)}
    assert {r.id for r in bad.collect()} == {"x", "y", "o"}


@pytest.mark.parametrize("part_rows", [10_000, 2])
def test_nest_and_shred_are_inverse(spark, part_rows):
    parents = spark.range(4).withColumnRenamed("id", "p")
    children = spark.range(21).select((F.col("id") % 3).alias("p"), F.floor(F.col("id") / 3).cast("int").alias("pos"), F.col("id").alias("v"))
    nested = tree.nest(parents, children, ["p"], "pos", ["v"], "items", part_rows)
    assert nested.select(F.max(F.size("items"))).first()[0] <= part_rows
    assert sorted(tree.shred(nested, ["p"], "items").collect()) == sorted(children.select("p", "pos", "v").collect())
    assert nested.filter("p = 3").count() == 1


@pytest.mark.parametrize("part_rows", [10_000, 2])
def test_assemble_and_shred_all(spark, part_rows):
    s = spark.createDataFrame
    flat = {
        "restaurants": s([("r1", "A"), ("r2", "B")], "restaurant_id string, name string"),
        "locations": s([("r1", 10_000, "X"), ("r1", 10_001, "Y")], "restaurant_id string, pos int, city string"),
        "menus": s([("m1", "r1", 0), ("m2", "r2", 10_000)], "menu_id string, restaurant_id string, pos int"),
        "categories": s([("c1", "m1", None, 0), ("c2", "m1", "c1", 1)], "category_id string, menu_id string, parent_id string, pos int"),
        "dishes": s([("c1", 0, "d1"), ("c2", 0, "d2"), ("c2", 1, "d3")], "category_id string, pos int, dish string"),
    }
    nested = tree.assemble(**flat, part_rows=part_rows)
    back = tree.shred_all(nested)
    assert nested["menus"].filter("restaurant_id = 'r1'").count() == (1 if part_rows > 9 else 3)
    for name, df in flat.items():
        columns = sorted(df.columns)
        assert sorted(map(tuple, back[name].select(columns).collect()), key=str) == sorted(map(tuple, df.select(columns).collect()), key=str), name
    counts = {r.restaurant_id: r.n for r in nested["menus"].select("restaurant_id", tree.top_level_dish_count().alias("n")).groupBy("restaurant_id").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"r1": 1, "r2": 0}


def test_derived_dishes_have_the_rule_columns(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert {"path", "nutrition", "ingredients", "allergens"} <= set(derived_dishes(part).columns)


def test_whole_orders_and_lines_are_tested_for_nested_records(spark, tmp_path):
    spark.createDataFrame([(1, 7, "P"), (2, 8, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(4, 1, 0.06), (4, 2, 0.07), (4, 3, 0.01), (5, 2, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r.restaurant_id, r.field_path.rpartition(".")[2]) for r in validation.nested_records(Tables(spark, str(tmp_path))).collect())
    assert got == [(4, "colour")] * 3 + [(4, "price")] * 2 + [(5, "colour"), (7, "name")]


def test_types_of_lists_objects_and_absent_fields(spark):
    record = Record(
        (Rule("tags", "array", nullable=False), Rule("box", "object"), Rule("box.in", "object", nullable=False), Rule("box.in.n", "int", required=True), Rule("far.off", required=True))
    )
    texts = [
        '{"tags": [], "box": {"in": {"n": 1}}, "far": {"off": "x"}}', '{"tags": {}, "box": [1]}', '{"tags": null, "box": null}', ' \n{"tags": "[]", "box": {"in": 4}}',
        '{"a": 1}', "[]", None, "{", '{"box": {"in": {"n": "x", "m": 1}}}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    got = {}
    for r in conform.flat_schema_issues(rows, ["k"], "j", record).collect():
        got.setdefault(r.k, set()).add((r.field_path, r.message.split()[-1]))
    lack = {("box.in.n", "required"), ("far.off", "required")}
    assert got == {
        0: {("far", "permitted")},
        1: {("tags", "list"), ("box", "dictionary"), *lack}, 2: {("tags", "list"), *lack}, 3: {("tags", "list"), ("box.in", "dictionary"), *lack}, 4: {("a", "permitted"), *lack},
        **{k: {("<root>", "dictionary")} for k in (5, 6, 7)}, 8: {("box.in.n", "integer"), ("box.in.m", "permitted"), ("far.off", "required")},
    }


def test_only_fields_that_can_fail_are_looked_at(spark):
    """A record with many optional fields costs little where they are absent."""
    decode, below = conform._decoder(), [{"a": 0}]
    seen = []
    conform.nested_records(lambda t, at: seen.append(at) or decode(t, at), '{"x": [{"b": 1}], "y": 2}', below)
    assert len(seen) == 1


def _odd_texts() -> list[str | None]:
    """Records as they should be and with values of all kinds in all places, and texts that are hardly JSON."""
    import random

    rng = random.Random(7)
    values = [
        None, True, False, 0, 1, -1, 2.0, 1.5, -0.0, 1e15, -1e300, 10**40, 12345678901234567890, "", " ", "\u00a0\u2003", "x", "USD", "usd\u00e9", "TRUE", "T", "maybe", "12.5", "-3", "1e3",
        " 7", "NaN", "1d", "0x1", "pending", "milk", "a" * 256, "\U0001f600" * 130, "\u017f", [], [None], ["milk"], ["milk", "sand"], ["milk", 5], [["milk"]], {}, {"a": 1}, '{"a": 1}', "[1]", "tab\there", "nul\x00",
    ]

    def record(kind: Record, depth: int) -> dict:
        out: dict = {}
        for rule in kind.fields:
            if not rule.required and rng.random() < 0.75:
                continue
            good = {"string": "USD" if rule.max_len in (2, 3) else "pending", "decimal": 4, "int": 3, "bool": True, "array": [], "object": {}}[rule.type]
            if rng.random() < 0.03:
                continue
            at, names = out, rule.name.split(".")
            for name in names[:-1]:
                at = at.setdefault(name, {}) if isinstance(at, dict) else {}
            if isinstance(at, dict):
                at[names[-1]] = good if rng.random() < 0.8 else rng.choice(values)
        if rng.random() < 0.1:
            out[rng.choice(["", "<root>", "a.b", "na\u00efve", "q\"", "name "])] = rng.choice(values)
        for name, child in kind.children.items():
            if depth < 5 and rng.random() < 0.6:
                child = kind if child == "self" else child
                out[name] = [record(child, depth + 1) if rng.random() < 0.93 else rng.choice(values) for _ in range(rng.randrange(3))] if rng.random() < 0.95 else rng.choice(values)
        return out

    made = [record(RESTAURANT_RECORD, 0) for _ in range(250)]
    by_hand = [
        None, "", "{", "[]", "null", "3", '"x"', '{"name": "a"} x', ' \n{"name": "a"}\t ', '\ufeff{"name": "a"}', '{"name": "a", "name": "b"}', '{"name": "a", "id": NaN}', '{"name": "a", "locations": [{"a": 01}]}',
        '{"name": "a", "menus": [{"name": "b", "x": {"y": 1, "y": 2}}]}', '{"name": "\\ud83d\\ude00", "menus": [{}, null, 3, []]}', '{"name": "\\ud83d", "menus": [{"name": ""}]}', '{"n\\u0061me": "\\u0020", "\\u006denus": [{"name": " "}]}',
        '{"name": "a\tb"}', '{"name": "a", "x": ' + "[" * 400 + "]" * 400 + "}", '{"name": "a", "x": ' + "[" * 1200 + "]" * 1200 + ', "menus": [{"name": ""}]}', '{"name": "a", "x": ' + "9" * 999 + "}", '{"name": "a", "x": ' + "9" * 1500 + "}",
        '{"name": "a", "' + "k" * 50_001 + '": 1}', '{"name": "a", "' + "k" * 49_000 + '": "' + "v" * 60_000 + '"}', '{"name": "a", "x": 1e400, "y": -0, "z": 1E-400}', "{'name': 'a'}", '{"name": "a",}', '{"name": "a" /* b */}',
        *('{"name": "n", "menus": [{"categories": [{"name": "c", "dishes": [{"name": "d", "category_id": "e", %s}]}]}]}' % x for x in (
            '"price": 1e400', '"price": -1e-400', '"price": 1.00000000000000000000000000000000000000001', '"price": -0.0', '"price": "1e400"', '"price": "-1 "', '"price": "0012.50"', '"price": 1E2',
            '"nutrition": null', '"nutrition": []', '"nutrition": "{\\"b\\": 1}"', '"nutrition": {"macros": "x"}', '"nutrition": {"macros": {"calories": -1, "b": 2}, "c": 3}', '"allergens": null', '"allergens": [null, "milk"]', '"allergens": "milk"',
        )),
    ]
    return by_hand + [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(made)]


def test_decoded_records_and_expressions_find_the_same(spark, monkeypatch):
    texts = _odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string").repartition(4)
    find = lambda: sorted(map(tuple, conform.schema_issues(rows, ["k"], "j", RESTAURANT_RECORD).collect()))
    got = find()
    plain = conform.plain_problems
    test, once = conform._record_tests(*_kinds_below())[0], conform._decoder(object_pairs_hook=conform._once)
    decided = [plain(t, test, once, once) is not None for t in texts[-250:]]
    assert sum(decided) > 50
    monkeypatch.setattr(conform, "plain_problems", lambda *args: None)
    assert got == find()


def _kinds_below():
    kinds = conform._kinds(RESTAURANT_RECORD)
    return kinds, [{n: next(i for i, k in enumerate(kinds) if k is (kind if c == "self" else c)) for n, c in kind.children.items()} for kind in kinds]


def test_whole_texts_are_judged_where_they_are_decoded():
    """Plain records need no expression; what Python may read differently is left to them."""
    test, once = conform._record_tests(*_kinds_below())[0], conform._decoder(object_pairs_hook=conform._once)
    plain = lambda text: conform.plain_problems(text, test, once, once)
    text = '{"name": "n\\u00e9", "a": 1, "menus": [{"name": ""}, {"categories": [{"children": [5], "dishes": [{"name": "e", "category_id": "f", "price": "-0.01"}]}]}]}'
    assert sorted(plain(text)) == [
        ("", "a", conform.EXTRA), ("menus.0.", "name", "String should have at least 1 character"), ("menus.1.categories.0.", "name", conform.MISSING),
        ("menus.1.categories.0.children.0.", "<root>", "Input should be a valid dictionary"), ("menus.1.categories.0.dishes.0.", "price", "Input should be greater than or equal to 0"),
    ]
    for odd in (None, "{", '{"name": "a", "name": "b"}', '{"name": "\\ud800"}', '{"name": "a"} x', '{"menus": [{"x": {"y": 1, "y": 2}}]}'):
        assert plain(odd) is None


def _odd_catalog(spark):
    """Menus, categories and dishes that repeat, lack keys or positions, hang on nothing or stand at negative places."""
    menus = [("m1", "r1", 1, "a"), ("m1", "r1", 1, "a"), ("m2", "r1", 0, "b"), ("m2", "r2", None, "b"), (None, "r1", 1, "c"), ("m3", None, 2, "d")]
    categories = [
        ("c1", "m1", None, 0, "x"), ("c1", "m1", None, 0, "x"), ("c2", "m1", "c1", None, "y"), ("c3", "m1", None, -1, "z"), ("c4", "m1", None, -3, "z"), ("c5", "m2", "c4", 5, "u"),
        (None, "m1", None, 2, "v"), ("c6", None, None, 0, "w"), ("c7", "gone", None, 0, "w"), ("c5", "m3", None, 1, "t"), ("c8", "m2", None, 6, "s"),
    ]
    dishes = [(c, pos, f"d{c}{pos}") for c in ("c1", "c2", "c3", "c4", "c5", "c6", "c7", "gone", None) for pos in (None, -4, -1, 0, 1, 2, 3)] + [("c1", 1, "dc11"), ("c5", 9, "e")]
    s = spark.createDataFrame
    flat = {
        "restaurants": s([("r1", "A")], "restaurant_id string, name string"), "locations": s([("r1", 1, "X")], "restaurant_id string, pos int, city string"),
        "menus": s(menus, "menu_id string, restaurant_id string, pos int, name string"), "categories": s(categories, "category_id string, menu_id string, parent_id string, pos int, status string"),
        "dishes": s(dishes, "category_id string, pos int, dish string"),
    }
    return flat, menus, categories, dishes


def _numbered_parts(menus, categories, dishes, part_rows):
    """(restaurant, part, menu, category or None) -> [begins, dishes], from one sorted list of entries a restaurant."""
    entries = [(r, p, m, -1, None, -1, None, n) for m, r, p, n in menus]
    for c, m, _, pos, status in categories:
        for menu, r, p, _ in menus:
            if m is not None and m == menu:
                entries += [(r, p, m, pos, c, -1, None, status)] + [(r, p, m, pos, c, at, d, None) for own, at, d in dishes if own == c and c is not None]
    first = lambda x: (x is not None, x)
    out, last, no = {}, object(), 0
    for r, p, m, pos, c, at, d, begins in sorted(entries, key=lambda e: (first(e[0]), first(e[1]), first(e[2]), first(e[3]), first(e[4]), first(e[5]), first(e[6]))):
        no = 0 if r != last else no + 1
        last = r
        if pos is None:
            continue
        menu = out.setdefault((r, no // part_rows, p, m, None), [None, []])
        here = out.setdefault((r, no // part_rows, p, m, (pos, c)), [None, []]) if pos >= 0 and c is not None else menu if c is None and pos < 0 else [None, []]
        here[0] = begins or here[0]
        here[1] += [(at, d)] if at is not None and at >= 0 and pos >= 0 else []
    return out


@pytest.mark.parametrize("part_rows", [1, 4, 1000])
@pytest.mark.parametrize("limit", ["0", "3", "2000000"])
def test_parts_are_numbered_in_document_order(spark, part_rows, limit):
    flat, *rows = _odd_catalog(spark)
    spark.conf.set("spark.menuloom.hotGroupRows", limit)
    spark.conf.set("spark.menuloom.chunkRows", "4")
    try:
        got = {}
        for row in tree.assemble(**flat, part_rows=part_rows)["menus"].collect():
            for m in row.menus:
                at = (row.restaurant_id, row.part, m.pos, m.menu_id)
                assert (*at, None) not in got
                got[(*at, None)] = [m.menu and m.menu.name, []]
                for c in m.categories:
                    got[(*at, (c.pos, c.category_id))] = [c.category and c.category.status, [(d.pos, d.dish.dish) for d in c.dishes]]
    finally:
        spark.conf.unset("spark.menuloom.hotGroupRows")
        spark.conf.unset("spark.menuloom.chunkRows")
    assert got == _numbered_parts(*rows, part_rows)


def test_dishes_are_dealt_twice_only(spark):
    """Once to their category and once, listed, to their part, also where restaurants have many; all other
    steps move categories and menus."""
    flat, *_ = _odd_catalog(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.menuloom.hotGroupRows": "10"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = tree.assemble(**flat, part_rows=4)["menus"]
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    finally:
        for key in conf:
            spark.conf.unset(key)
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len([columns for columns in dealt if re.search(r"\b(dish|dishes|buf)#", columns)]) == 2


@pytest.mark.parametrize("chunk", ["2", "250000"])
def test_totals_before_in_groups_of_any_size(spark, hot_groups, chunk):
    spark.conf.set("spark.menuloom.chunkRows", chunk)
    rows = [(k, i, i * 7 % 5) for k in ("a", None) for i in range(20)] + [("b", 0, 3), ("b", 1, 4)]
    try:
        got = totals_before(spark.createDataFrame(rows, "k string, i int, size long"), ["k"], ["i"], "size", "before").collect()
    finally:
        spark.conf.unset("spark.menuloom.chunkRows")
    assert {(r.k, r.i): r.before for r in got} == {(k, i): sum(s for j, n, s in rows if j == k and n < i) for k, i, _ in rows}
    assert len(got) == len(rows)
