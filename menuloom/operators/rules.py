"""Deterministic rules: dish and restaurant rows to issue rows.

All single-row rules are column expressions evaluated in one pass over the
dishes; only duplicate names need a count per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.let import let
from ..functions.text import normalize_name
from ..session import reliable_checkpoint
from .groups import join_group_facts, join_keys

ERROR, WARNING = "error", "warning"
# Characters of the words that one automaton holds, about.
SHARD_CHARS = 8_000_000

# Energy per gram, tolerances and plausibility bounds.
KCAL_PER_G_PROTEIN = 4
KCAL_PER_G_CARB = 4
KCAL_PER_G_FAT = 9
ENERGY_RELATIVE_TOLERANCE = "0.35"
ENERGY_ABSOLUTE_TOLERANCE = 50
MAX_CALORIES = 5000
MAX_SODIUM_MG = 10000
MAX_PRICE = 500

# Words in an ingredient name that imply an allergen.
ALLERGEN_WORDS = {
    "milk": "milk",
    "cheese": "milk",
    "butter": "milk",
    "cream": "milk",
    "yogurt": "milk",
    "egg": "eggs",
    "mayonnaise": "eggs",
    "shrimp": "shellfish",
    "crab": "shellfish",
    "lobster": "shellfish",
    "peanut": "peanuts",
    "almond": "tree_nuts",
    "walnut": "tree_nuts",
    "cashew": "tree_nuts",
    "pecan": "tree_nuts",
    "wheat": "wheat",
    "flour": "wheat",
    "soy": "soy",
    "tofu": "soy",
    "sesame": "sesame",
    "tahini": "sesame",
}

# A part can never exceed its whole.
PART_OF_WHOLE = (
    ("saturated_fat_g", "fat_g", "saturated_fat_exceeds_total_fat"),
    ("trans_fat_g", "fat_g", "trans_fat_exceeds_total_fat"),
    ("sugar_g", "carbohydrates_g", "sugar_exceeds_total_carbohydrates"),
    ("fiber_g", "carbohydrates_g", "fiber_exceeds_total_carbohydrates"),
)


def _macro(name: str) -> Column:
    return F.col("nutrition.macros." + name)


def issue(test: Column, field: Column | str, code: str, severity: str, message: Column) -> Column:
    """An issue struct where the test holds, else null."""
    at = F.concat(F.col("path"), F.lit(field)) if isinstance(field, str) else field
    return F.when(
        test,
        F.struct(at.alias("field_path"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")),
    )


def _txt(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def energy_from_macros() -> Column:
    return (
        _macro("protein_g") * KCAL_PER_G_PROTEIN
        + _macro("carbohydrates_g") * KCAL_PER_G_CARB
        + _macro("fat_g") * KCAL_PER_G_FAT
    )


def presence_rules() -> list[Column]:
    any_value = F.coalesce(*[_macro(m) for m in ("calories", "protein_g", "carbohydrates_g", "fat_g")]).isNotNull()
    serving = F.coalesce(F.col("nutrition.serving_size"), F.lit(""))
    return [
        issue(F.col("price").isNull(), ".price", "missing_price", WARNING, _txt("Dish '", F.col("name"), "' has no price.")),
        issue(~any_value, ".nutrition", "missing_nutrition", WARNING, _txt("Dish '", F.col("name"), "' has no nutrition data.")),
        issue(
            any_value & (serving == ""), ".nutrition.serving_size", "missing_serving_size", WARNING,
            F.lit("Nutrition values are given without a serving size."),
        ),
    ]


def nutrition_rules() -> list[Column]:
    expected = energy_from_macros()
    tolerance = F.greatest(
        F.lit(ENERGY_ABSOLUTE_TOLERANCE).cast("decimal(20,5)"),
        (expected * F.lit(ENERGY_RELATIVE_TOLERANCE).cast("decimal(3,2)")).cast("decimal(20,5)"),
    )
    calories, sodium = _macro("calories"), _macro("sodium_mg")
    rules = [
        issue(
            F.abs(calories - expected) > tolerance, ".nutrition.macros.calories", "atwater_mismatch", WARNING,
            _txt("Calories ", calories, " differ from the estimate by macros ", expected, " beyond tolerance."),
        ),
        issue(
            calories > MAX_CALORIES, ".nutrition.macros.calories", "implausible_calories", ERROR,
            _txt(calories, f" kcal is above the plausible bound of {MAX_CALORIES}."),
        ),
        issue(
            sodium > MAX_SODIUM_MG, ".nutrition.macros.sodium_mg", "implausible_sodium", ERROR,
            _txt(sodium, f" mg sodium is above the plausible bound of {MAX_SODIUM_MG}."),
        ),
    ]
    for part, whole, code in PART_OF_WHOLE:
        rules.append(
            issue(
                _macro(part) > _macro(whole), f".macros.{part}", code, ERROR,
                _txt(f"{part} (", _macro(part), f") is more than {whole} (", _macro(whole), ")."),
            )
        )
    return rules


def price_rules() -> list[Column]:
    price, currency = F.col("price"), F.col("currency")
    well_formed = currency.rlike(r"^\p{L}{3}$")
    return [
        issue(price > MAX_PRICE, ".price", "implausible_price", ERROR,
              _txt("Price ", price, " ", currency, f" is above the plausible bound of {MAX_PRICE}.")),
        issue(price == 0, ".price", "zero_price", WARNING, F.lit("Price is 0; confirm the item is free.")),
        issue(~well_formed, ".currency", "malformed_currency_code", ERROR,
              _txt("'", currency, "' is not a three-letter currency code.")),
        issue(well_formed & (currency != F.upper(currency)), ".currency", "lowercase_currency_code", WARNING,
              _txt("Currency '", currency, "' should be upper case.")),
    ]


def implied_allergens(ingredients: Column) -> Column:
    """Allergens the ingredient names imply, sorted. The word list is a fixed 21
    entries, so it is tested inside the row and nothing is joined."""

    def hits(text: Column) -> Column:
        return F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(a)) for w, a in ALLERGEN_WORDS.items()])

    names = F.array_join(F.transform(ingredients, lambda i: i["name"]), "\n")
    return F.sort_array(F.array_distinct(F.array_compact(let(F.lower(names), hits))))


def undeclared_allergens() -> Column:
    declared = F.coalesce(F.col("allergens"), F.array().cast("array<string>"))
    found = F.array_except(implied_allergens(F.col("ingredients")), declared)  # keeps the order
    at = F.concat(F.col("path"), F.lit(".allergens"))
    return F.coalesce(
        F.transform(
            found,
            lambda a: F.struct(
                at.alias("field_path"), F.lit("possible_undeclared_allergen").alias("code"),
                F.lit(WARNING).alias("severity"),
                F.concat(F.lit("Ingredients suggest '"), a, F.lit("' but it is not declared.")).alias("message"),
            ),
        ),
        F.array(),
    )


def dish_issues(dishes: DataFrame, keys: Sequence[str], rules: Sequence[Column] | None = None) -> DataFrame:
    """Issue rows of all single-row rules, in rule order, without a shuffle.
    ``dishes`` has the dish columns and ``path``, the label of its place."""
    single = list(rules) if rules is not None else [*presence_rules(), *nutrition_rules(), *price_rules()]
    found = F.array(*single)
    if rules is None:
        found = F.concat(found, undeclared_allergens())
    exploded = dishes.select(*keys, F.explode(found).alias("_i"))
    return exploded.filter(F.col("_i").isNotNull()).select(*keys, "_i.*")


def allergen_issues(dishes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return dishes.select(*keys, F.explode(undeclared_allergens()).alias("_i")).select(*keys, "_i.*")


def words_inside(rows: DataFrame, words: DataFrame, keys: Sequence[str], text: str, word: str, value: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(keys, value) of every word that a text holds as a substring, each pair once a text. ``words`` are
    (word, value) rows of any number: they are dealt into shards of at most about ``shard_chars``
    characters, and each text is scanned once a shard by an Aho-Corasick automaton, in time
    that follows the text, not the words. Empty words and null texts hold nothing."""
    spark, keys = rows.sparkSession, list(keys)
    known = reliable_checkpoint(words.where(F.length(word) > 0).select(F.col(word).alias("_word"), F.col(value).alias("_value")).distinct())
    chars = known.agg(F.coalesce(F.sum(F.length("_word")), F.lit(0))).first()[0]
    shards = -(-chars // shard_chars)
    source = rows.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField(value, known.schema["_value"].dataType)])
    kind = to_arrow_type(known.schema["_value"].dataType)

    def scanned(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w, v in zip(*sent.value, strict=True):
                machine.get(w, None) or machine.add_word(w, [])
                machine.get(w).append(v)
            machine.make_automaton()
            for batch in batches:
                rows, values = [], []
                for i, body in enumerate(batch.column(len(keys)).to_pylist()):
                    found = dict.fromkeys(v for _, held in machine.iter(body) for v in held)
                    rows += [i] * len(found)
                    values += found
                own = batch.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(values, kind)], [*keys, value])

        return source.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for n in range(shards):
        shard = known.where(F.pmod(F.xxhash64("_word"), F.lit(shards)) == n).toArrow()
        if len(shard):
            out = out.unionByName(scanned(spark.sparkContext.broadcast((shard.column("_word").to_pylist(), shard.column("_value").to_pylist()))))
    return out


def undeclared_by_word_table(
    ingredients: DataFrame, declared: DataFrame, words: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The same test against a word table of the caller, of any size: (keys, name) rows
    against (word, allergen) rows by ``contains``, minus what is declared."""
    names = ingredients.select(*keys, F.lower(F.col("name")).alias("name"))
    found = words_inside(names, words, keys, "name", "word", "allergen").distinct()
    return join_keys(found, declared.select(*keys, "allergen"), [*keys, "allergen"], "left_anti")


def duplicate_groups(dishes: DataFrame, scope: Sequence[str], name: str = "name") -> DataFrame:
    """(scope, name_key, copies) of every normalised name used twice or more. A null part of
    the scope is a scope like any other; rows without a name are no duplicates.
    Counts combine map-side, so a name held by a third of all rows is cheap."""
    return (
        dishes.groupBy(*scope, normalize_name(F.col(name)).alias("name_key"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") >= 2) & F.col("name_key").isNotNull())
    )


def duplicate_members(dishes: DataFrame, scope: Sequence[str], name: str = "name") -> DataFrame:
    """Every member of a duplicate group with the group's size."""
    keyed = dishes.withColumn("name_key", normalize_name(F.col(name)))
    return join_group_facts(keyed, duplicate_groups(dishes, scope, name), [*scope, "name_key"], "copies")


def duplicate_issues(dishes: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """A warning on every copy. The other copies' paths are the rows of
    ``duplicate_members`` with the same name, not a list in each message: a list
    would square the output of a large group."""
    return duplicate_members(dishes, scope).select(
        *keys,
        F.concat(F.col("path"), F.lit(".name")).alias("field_path"),
        F.lit("duplicate_dish_name").alias("code"),
        F.lit(WARNING).alias("severity"),
        _txt("'", F.col("name_key"), "' appears ", F.col("copies"), " times; these may be duplicates.").alias("message"),
    )


def restaurant_issues(
    restaurants: DataFrame, locations: DataFrame, menus: DataFrame, dish_keys: DataFrame, key: str = "restaurant_id"
) -> DataFrame:
    """Missing locations, missing menus, menus without any dish. The three
    tables carry ``key``; each is counted per restaurant before it is joined."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    facts = restaurants.select(key)
    for df, name in ((locations, "_locations"), (menus, "_menus"), (dish_keys, "_dishes")):
        facts = join_keys(facts, counts(df, name), [key], "left")
    none = lambda c: F.col(c).isNull()
    found = F.array(
        issue(none("_locations"), F.lit("locations"), "missing_locations", WARNING, F.lit("Restaurant has no locations.")),
        issue(none("_menus"), F.lit("menus"), "missing_menus", ERROR, F.lit("Restaurant has no menus.")),
        issue(~none("_menus") & none("_dishes"), F.lit("menus"), "empty_menus", ERROR,
              F.lit("Restaurant has menus but no dishes in any of them.")),
    )
    return facts.select(key, F.explode(F.filter(found, lambda i: i.isNotNull())).alias("_i")).select(key, "_i.*")
