"""Queries for conformance, rules, corrections and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conform, corrections, report, rules
from ..schema import Record, Rule
from .base import Tables, query, sql_collapse, with_dishes

KEYS = ["restaurant_id", "dish_id"]
ISSUE_COLUMNS = "restaurant_id, dish_id, field_path, code, severity"
NORM = f"lower({sql_collapse('name')})"
EXPECTED = "(4 * protein_g + 4 * carbohydrates_g + 9 * fat_g)"


def _issues(t: Tables, codes: list[str], chosen) -> object:
    found = rules.dish_issues(t.dishes, KEYS, chosen)
    return found.filter(F.col("code").isin(codes)).select(*KEYS, "field_path", "code", "severity")


def _rule_sql(*cases: tuple[str, str, str, str]) -> str:
    return with_dishes(" UNION ALL ".join(
        f"SELECT restaurant_id, dish_id, path || '{at}' AS field_path, '{code}' AS code, '{sev}' AS severity "
        f"FROM dishes WHERE {test}" for at, code, sev, test in cases
    ))


_ANY = "coalesce(calories, protein_g, carbohydrates_g, fat_g) IS NOT NULL"
_LETTERS = r"regexp_full_match(currency, '\p{L}{3}')"
_RULES = {
    "v04_missing_price": (rules.presence_rules, [(".price", "missing_price", "warning", "price IS NULL")]),
    "v05_missing_nutrition": (rules.presence_rules, [(".nutrition", "missing_nutrition", "warning", f"NOT ({_ANY})")]),
    "v06_missing_serving_size": (
        rules.presence_rules,
        [(".nutrition.serving_size", "missing_serving_size", "warning", f"{_ANY} AND coalesce(serving_size, '') = ''")],
    ),
    "v07_atwater": (
        rules.nutrition_rules,
        [(".nutrition.macros.calories", "atwater_mismatch", "warning",
          f"abs(calories - {EXPECTED}) > greatest(50, 0.35 * {EXPECTED})")],
    ),
    "v08_implausible_nutrition": (
        rules.nutrition_rules,
        [(".nutrition.macros.calories", "implausible_calories", "error", "calories > 5000"),
         (".nutrition.macros.sodium_mg", "implausible_sodium", "error", "sodium_mg > 10000")],
    ),
    "v09_price_bounds": (
        rules.price_rules,
        [(".price", "implausible_price", "error", "price > 500"), (".price", "zero_price", "warning", "price = 0")],
    ),
    "v10_currency_code": (
        rules.price_rules,
        [(".currency", "malformed_currency_code", "error", f"NOT {_LETTERS}"),
         (".currency", "lowercase_currency_code", "warning", f"{_LETTERS} AND currency <> upper(currency)")],
    ),
    "v11_part_exceeds_whole": (
        rules.nutrition_rules,
        [(f".macros.{p}", c, "error", f"{p} > {w}") for p, w, c in rules.PART_OF_WHOLE],
    ),
}


def _register_rule(name, chosen, cases):
    @query(name, _rule_sql(*cases))
    def run(t: Tables):
        return _issues(t, [c[1] for c in cases], chosen())


for _name, (_chosen, _cases) in _RULES.items():
    _register_rule(_name, _chosen, _cases)


# --- restaurants derived from orders: lines are dishes ------------------------

def _restaurant_tables(t: Tables):
    restaurants = t.customer.select(F.col("c_custkey").alias("restaurant_id"))
    orders = t.orders.select(F.col("o_custkey").alias("restaurant_id"), "o_orderkey", "o_orderpriority")
    locations = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    menus = orders.filter(F.col("o_orderpriority") != "5-LOW")
    lines = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    dish_keys = lines.join(menus, "o_orderkey").select("restaurant_id")
    return restaurants, locations, menus, dish_keys


@query("v01_v02_v03_restaurant_rules", """
WITH r AS (
  SELECT c_custkey AS restaurant_id,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_location,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority <> '5-LOW') AS has_menu,
    EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey
            AND o_orderpriority <> '5-LOW' AND l_returnflag = 'R') AS has_dish
  FROM customer)
SELECT restaurant_id, 'locations' AS field_path, 'missing_locations' AS code, 'warning' AS severity FROM r WHERE NOT has_location
UNION ALL SELECT restaurant_id, 'menus', 'missing_menus', 'error' FROM r WHERE NOT has_menu
UNION ALL SELECT restaurant_id, 'menus', 'empty_menus', 'error' FROM r WHERE has_menu AND NOT has_dish""")
def restaurant_rules(t: Tables):
    return rules.restaurant_issues(*_restaurant_tables(t)).drop("message")


_WORDS_SQL = "(VALUES " + ", ".join(f"('{w}', '{a}')" for w, a in rules.ALLERGEN_WORDS.items()) + ") AS w(word, allergen)"
_UNDECLARED = (
    f"SELECT DISTINCT restaurant_id, dish_id, path, allergen FROM (SELECT restaurant_id, dish_id, path, allergens, "
    f"unnest(ingredients) AS ingredient FROM dishes) JOIN {_WORDS_SQL} ON contains(lower(ingredient), word) "
    "WHERE NOT list_contains(allergens, allergen)"
)


@query("v12_undeclared_allergen", with_dishes(
    "SELECT restaurant_id, dish_id, path || '.allergens' AS field_path, 'possible_undeclared_allergen' AS code, "
    "'warning' AS severity, 'Ingredients suggest ''' || allergen || ''' but it is not declared.' AS message "
    f"FROM ({_UNDECLARED})"))
def allergens(t: Tables):
    return rules.allergen_issues(t.dishes, KEYS)


@query("j05_ingredient_word_join", with_dishes(f"SELECT dish_id, allergen FROM ({_UNDECLARED})"))
def word_join(t: Tables):
    d = t.dishes
    words = t.spark.createDataFrame(list(rules.ALLERGEN_WORDS.items()), "word string, allergen string")
    ingredients = d.select("dish_id", F.explode("ingredients.name").alias("name"))
    declared = d.select("dish_id", F.explode("allergens").alias("allergen"))
    return rules.undeclared_by_word_table(ingredients, declared, words, ["dish_id"])


_GROUPS = (
    f"SELECT restaurant_id, menu_pos, {NORM} AS name_key, count(*) AS copies FROM dishes GROUP BY ALL HAVING count(*) >= 2"
)


@query("v13_duplicate_dish_name", with_dishes(
    f", g AS ({_GROUPS}) SELECT restaurant_id, dish_id, path || '.name' AS field_path, 'duplicate_dish_name' AS code, "
    "'warning' AS severity, '''' || name_key || ''' appears ' || copies || ' times; these may be duplicates.' AS message "
    f"FROM (SELECT *, {NORM} AS name_key FROM dishes) JOIN g USING (restaurant_id, menu_pos, name_key)"))
def duplicates(t: Tables):
    return rules.duplicate_issues(t.dishes, KEYS, ["restaurant_id", "menu_pos"])


@query("a05_duplicate_groups", with_dishes(
    f", g AS ({_GROUPS}) SELECT restaurant_id, menu_pos, name_key, copies, path "
    f"FROM (SELECT *, {NORM} AS name_key FROM dishes) JOIN g USING (restaurant_id, menu_pos, name_key)"))
def duplicate_groups(t: Tables):
    return rules.duplicate_members(t.dishes, ["restaurant_id", "menu_pos"]).select(
        "restaurant_id", "menu_pos", "name_key", "copies", "path"
    )


@query("v13_duplicate_dish_name_whole_catalog", f"""
WITH g AS (SELECT {NORM.replace('name', 'p_name')} AS name_key, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) >= 2)
SELECT p_partkey, name_key, copies FROM (SELECT *, {NORM.replace('name', 'p_name')} AS name_key FROM part) JOIN g USING (name_key)""")
def duplicates_whole(t: Tables):
    """Scope by brand-less name over the whole table: a few very large groups."""
    return rules.duplicate_members(t.part, [], "p_name").select("p_partkey", "name_key", "copies")


# --- corrections --------------------------------------------------------------

_FIXED = f"""
, keyed AS (SELECT *, list_transform(ingredients, lambda i: lower({sql_collapse('i')})) AS keys FROM dishes)
, fixed AS (SELECT *, CASE WHEN {_LETTERS} THEN upper(currency) ELSE currency END AS new_currency,
   {sql_collapse('description')} AS new_description,
   list_filter(ingredients, lambda i, n: list_position(keys, keys[n]) = n) AS new_ingredients FROM keyed)"""


@query("c01_c02_c03_corrected_dishes", with_dishes(
    f"{_FIXED} SELECT dish_id, new_currency AS currency, new_description AS description, "
    "array_to_string(new_ingredients, '|') AS ingredients FROM fixed"))
def corrected(t: Tables):
    fixed = corrections.corrected_only(corrections.correct_dishes(t.dishes))
    return fixed.select("dish_id", "currency", "description", F.array_join("ingredients.name", "|").alias("ingredients"))


@query("c04_correction_log", with_dishes(f"""{_FIXED}
SELECT restaurant_id, dish_id, path || '.currency' AS field_path, currency AS old_value, new_currency AS new_value,
  '{corrections.REASONS['currency']}' AS reason FROM fixed WHERE currency <> new_currency
UNION ALL SELECT restaurant_id, dish_id, path || '.description', description, new_description,
  '{corrections.REASONS['description']}' FROM fixed WHERE description <> new_description
UNION ALL SELECT restaurant_id, dish_id, path || '.ingredients', to_json(ingredients)::VARCHAR, to_json(new_ingredients)::VARCHAR,
  '{corrections.REASONS['ingredients']}' FROM fixed WHERE len(ingredients) <> len(new_ingredients)"""))
def correction_log(t: Tables):
    return corrections.correction_log(corrections.correct_dishes(t.dishes), KEYS)


# --- closed-schema conformance ------------------------------------------------

# Fields of the JSON records built below; "size" may be missing or text.
PART_RECORD = Record((
    Rule("id", "int", required=True, nullable=False, ge=0),
    Rule("name", required=True, nullable=False, min_len=1, max_len=10, not_blank=True),
    Rule("size", "int", required=True, nullable=False, ge=1, le=40),
    Rule("type", nullable=False, one_of=("ECONOMY", "SMALL", "STANDARD", "PROMO", "LARGE")),
    Rule("price", "decimal", ge=0, le=950),
))


def _part_json(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        F.when(k % 50 == 7, F.lit("[1]")).otherwise(
            F.to_json(F.struct(
                k.alias("id"),
                F.when(k % 10 == 3, "  ").otherwise(F.col("p_name")).alias("name"),
                F.when(k % 8 != 1, F.col("p_size")).alias("size"),
                F.col("p_type").alias("type"),
                F.when(k % 6 == 2, F.lit("dear")).otherwise(F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias("price"),
                F.when(k % 12 == 5, F.col("p_brand")).alias("brand"),
            ))
        ).alias("record"),
    )


_TYPES = "'ECONOMY', 'SMALL', 'STANDARD', 'PROMO', 'LARGE'"


@query("p01_closed_schema", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN '  ' ELSE p_name END AS name,
  CASE WHEN p_partkey % 8 <> 1 THEN p_size END AS size, p_type, p_retailprice AS price, p_brand FROM part),
ok AS (SELECT * FROM p WHERE p_partkey % 50 <> 7)
SELECT p_partkey, '<root>' AS field_path, 'Input should be a valid dictionary' AS message FROM p WHERE p_partkey % 50 = 7
UNION ALL SELECT p_partkey, 'name', CASE WHEN length(name) > 10 THEN 'String should have at most 10 characters'
  ELSE 'Value error, this field cannot be blank' END FROM ok WHERE length(name) > 10 OR trim(name) = ''
UNION ALL SELECT p_partkey, 'size', CASE WHEN size IS NULL THEN 'Field required'
  ELSE 'Input should be less than or equal to 40' END FROM ok WHERE size IS NULL OR size > 40
UNION ALL SELECT p_partkey, 'type', 'Input should be one of ECONOMY, SMALL, STANDARD, PROMO, LARGE' FROM ok WHERE p_type NOT IN ({_TYPES})
UNION ALL SELECT p_partkey, 'price', CASE WHEN p_partkey % 6 = 2 THEN 'Input should be a valid number'
  ELSE 'Input should be less than or equal to 950' END FROM ok WHERE p_partkey % 6 = 2 OR price > 950
UNION ALL SELECT p_partkey, 'brand', 'Extra inputs are not permitted' FROM ok WHERE p_partkey % 12 = 5""")
def closed_schema(t: Tables):
    found = conform.flat_schema_issues(_part_json(t), ["p_partkey"], "record", PART_RECORD)
    return found.select("p_partkey", "field_path", "message")


@query("p01_conforming_records", f"""
SELECT p_partkey FROM part WHERE p_partkey % 50 <> 7 AND p_partkey % 10 <> 3 AND length(p_name) <= 10 AND p_partkey % 8 <> 1
  AND p_size <= 40 AND p_type IN ({_TYPES}) AND p_partkey % 6 <> 2 AND p_retailprice <= 950 AND p_partkey % 12 <> 5""")
def conforming(t: Tables):
    records = _part_json(t)
    issues = conform.flat_schema_issues(records, ["p_partkey"], "record", PART_RECORD)
    return conform.conforming(records, issues, ["p_partkey"]).select("p_partkey")


# Orders as restaurants with one menu, lines as restaurants with nested categories and dishes.
@query("p01_nested_records", """
SELECT o_custkey AS restaurant_id, 'menus.0.name' AS field_path, 'String should have at least 1 character' AS message
FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT l_orderkey, 'menus.1.categories.0.dishes.0.price', 'Input should be greater than or equal to 0'
FROM lineitem WHERE l_discount > 0.05
UNION ALL SELECT l_orderkey, 'menus.1.categories.0.children.0.colour', 'Extra inputs are not permitted' FROM lineitem""")
def nested_records(t: Tables):
    """Every order and every line is tested."""
    from ..schema import RESTAURANT_RECORD

    text = lambda pattern, *cols: F.format_string(pattern, *cols)
    by_order = t.orders.select(
        F.col("o_custkey").alias("restaurant_id"),
        text('{"name": "x", "menus": [{"name": "%s"}]}', F.when(F.col("o_orderstatus") == "P", "").otherwise("m")).alias("record"),
    )
    by_line = t.lineitem.select(
        F.col("l_orderkey").alias("restaurant_id"),
        text(
            '{"name": "n", "menus": [{"name": "a"}, {"categories": [{"name": "c", "children": [{"name": "d", "colour": 1}],'
            ' "dishes": [{"name": "e", "category_id": "f", "price": %s}]}]}]}',
            F.when(F.col("l_discount") > 0.05, "-0.01").otherwise("1.50"),
        ).alias("record"),
    )
    return conform.schema_issues(
        by_order.unionByName(by_line), ["restaurant_id"], "record", RESTAURANT_RECORD
    ).select("restaurant_id", "field_path", "message")


@query("p12_precondition_gate", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 6 = 0 THEN 'website/run required before capture'
  WHEN p_partkey % 4 = 0 THEN 'website required before capture' ELSE 'run required before capture' END AS error_message
FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 6 = 0""")
def precondition(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(k, F.when(k % 4 != 0, F.col("p_name")).alias("website"), F.when(k % 6 != 0, k).alias("run"))
    return conform.gate(rows, "capture", ["website", "run"])[1].select("p_partkey", "error_message")


# --- summaries ----------------------------------------------------------------

_ALL_CASES = [c for _, cases in _RULES.values() for c in cases]
_ISSUES_SQL = " UNION ALL ".join(
    f"SELECT restaurant_id, dish_id, path || '{at}' AS field_path, '{code}' AS code, '{sev}' AS severity FROM corrected WHERE {test}"
    for at, code, sev, test in _ALL_CASES
)
_CORRECTED = f", corrected AS (SELECT * REPLACE (CASE WHEN {_LETTERS} THEN upper(currency) ELSE currency END AS currency) FROM dishes)"
_FULL = (
    f"{_CORRECTED}, g AS ({_GROUPS}), undeclared AS ({_UNDECLARED}), issues AS ({_ISSUES_SQL} "
    "UNION ALL SELECT restaurant_id, dish_id, path || '.allergens', 'possible_undeclared_allergen', 'warning' FROM undeclared "
    "UNION ALL SELECT restaurant_id, dish_id, path || '.name', 'duplicate_dish_name', 'warning' "
    f"FROM (SELECT *, {NORM} AS name_key FROM dishes) JOIN g USING (restaurant_id, menu_pos, name_key))"
)


def dish_level_issues(t: Tables):
    fixed = corrections.corrected_only(corrections.correct_dishes(t.dishes))
    return rules.dish_issues(fixed, KEYS).unionByName(rules.duplicate_issues(fixed, KEYS, ["restaurant_id", "menu_pos"]))


@query("rules_issue_counts", with_dishes(
    f"{_FULL} SELECT code, severity, count(*) AS issues, count(DISTINCT restaurant_id) AS restaurants FROM issues GROUP BY ALL"))
def issue_counts(t: Tables):
    """Every dish rule on corrected rows, counted by code."""
    return dish_level_issues(t).groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("issues"), F.count_distinct("restaurant_id").alias("restaurants")
    )


@query("p11_issue_split", with_dishes(
    f"{_FULL} SELECT restaurant_id, dish_id, code FROM issues WHERE severity = 'error'"))
def issue_split(t: Tables):
    return report.split_by_severity(dish_level_issues(t))[0].select("restaurant_id", "dish_id", "code")


@query("a03_outcome_per_record", with_dishes(f"""{_FULL}
, c AS (SELECT restaurant_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1)
{_FIXED.replace('fixed AS', 'fixed AS')}
, f AS (SELECT restaurant_id, sum((currency <> new_currency)::INT + coalesce((description <> new_description)::INT, 0)
   + (len(ingredients) <> len(new_ingredients))::INT)::BIGINT AS n FROM fixed GROUP BY 1)
SELECT r.restaurant_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
  coalesce(errors, 0) + coalesce(warnings, 0) AS issue_count, coalesce(errors, 0) = 0 AS is_valid, coalesce(n, 0) AS corrected_fields
FROM (SELECT DISTINCT restaurant_id FROM dishes) r LEFT JOIN c USING (restaurant_id) LEFT JOIN f USING (restaurant_id)"""))
def outcome(t: Tables):
    d = t.dishes
    corrected_rows = corrections.correct_dishes(d)
    log = corrections.correction_log(corrected_rows, KEYS)
    return report.outcome_per_record(
        d.select("restaurant_id").distinct(), dish_level_issues(t), ["restaurant_id"], log
    )


@query("a04_first_error_messages", with_dishes(f"""{_CORRECTED}
, e AS ({" UNION ALL ".join(
    f"SELECT restaurant_id, dish_id, code, path || '{at}' AS field_path FROM (SELECT *, '{code}' AS code FROM corrected) WHERE {test}"
    for at, code, sev, test in _ALL_CASES if sev == 'error')})
SELECT restaurant_id, string_agg(code || ' at ' || field_path, '; ' ORDER BY dish_id, field_path, code) AS first_errors
FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY restaurant_id ORDER BY dish_id, field_path, code) <= 5) GROUP BY 1"""))
def first_errors(t: Tables):
    found = dish_level_issues(t).withColumn("message", F.concat("code", F.lit(" at "), "field_path"))
    return report.first_messages(found, ["restaurant_id"], ["dish_id", "field_path", "code"])
