"""Registry of queries over the shared tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The shared parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def dishes(self) -> DataFrame:
        return dishes(self.part)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- dishes derived from part -------------------------------------------------
# Restaurant = 20 parts in a row, two menus each, two categories per menu, five
# dishes per category. Prices, nutrients, ingredients follow from the key.

_K = "p_partkey"
_NUTRIENT = "decimal(12,3)"
INGREDIENT_WORDS = ("Whole Milk", "wheat flour", "sea salt", "Cheddar  cheese", "tofu", "Olive oil", "egg yolk")
ALLERGEN_CYCLE = ("milk", "wheat", "soy", "eggs")


def dishes(part: DataFrame) -> DataFrame:
    k, size = F.col(_K), F.col("p_size").cast("decimal(12,3)")
    word = lambda n: F.element_at(F.array(*[F.lit(w) for w in INGREDIENT_WORDS]), (n % 7 + 1).cast("int"))
    none = F.lit(None).cast(_NUTRIENT)
    num = lambda c: c.cast(_NUTRIENT)
    macros = F.struct(
        F.when(k % 9 == 0, none).when(k % 23 == 0, F.lit(5000).cast(_NUTRIENT)).when(k % 29 == 0, F.lit(5001).cast(_NUTRIENT))
        .otherwise(num(size * 17)).alias("calories"),
        F.when(k % 9 == 0, none).when(k % 8 == 0, none).otherwise(num(size * F.lit("0.5").cast("decimal(2,1)"))).alias("protein_g"),
        F.when(k % 9 == 0, none).otherwise(num(size * 2)).alias("carbohydrates_g"),
        F.when(k % 9 == 0, none).otherwise(num(k % 40)).alias("fat_g"),
        num(k % 15).alias("saturated_fat_g"),
        F.when(k % 3 == 0, num(k % 21)).alias("trans_fat_g"),
        num(k % 33).alias("fiber_g"),
        num(k % 71).alias("sugar_g"),
        F.when(k % 31 == 0, F.lit(10000).cast(_NUTRIENT)).when(k % 37 == 0, F.lit("10000.5").cast(_NUTRIENT)).otherwise(num(size * 11)).alias("sodium_mg"),
        none.alias("cholesterol_mg"),
    )
    return part.select(
        F.floor(k / 20).cast("long").alias("restaurant_id"),
        F.floor((k % 20) / 10).cast("int").alias("menu_pos"),
        F.floor((k % 10) / 5).cast("int").alias("category_pos"),
        (k % 5).cast("int").alias("pos"),
        k.alias("dish_id"),
        F.concat(
            F.lit("menus["), F.floor((k % 20) / 10).cast("int"), F.lit("].categories["),
            F.floor((k % 10) / 5).cast("int"), F.lit("].dishes["), (k % 5).cast("int"), F.lit("]"),
        ).alias("path"),
        F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))))
        .otherwise(F.col("p_name")).alias("name"),
        F.when(k % 5 == 0, F.concat("p_brand", F.lit("  of\t"), "p_type", F.lit(" "))).when(k % 5 != 4, F.concat_ws(" ", "p_brand", "p_type")).alias("description"),
        F.struct(
            F.when(k % 6 == 0, "").when(k % 6 != 1, F.concat(F.col("p_size").cast("string"), F.lit(" g"))).alias("serving_size"),
            macros.alias("macros"),
        ).alias("nutrition"),
        F.when(k % 2 == 0, F.array(F.element_at(F.array(*[F.lit(a) for a in ALLERGEN_CYCLE]), (k % 4 + 1).cast("int"))))
        .otherwise(F.array().cast("array<string>")).alias("allergens"),
        F.transform(
            F.filter(
                F.array(word(k), word(k + 2), F.when(k % 3 == 0, F.upper(word(k))), F.when(k % 7 == 0, word(k + 1))),
                lambda w: w.isNotNull(),
            ),
            lambda w: F.struct(w.alias("name"), F.lit(False).alias("is_optional")),
        ).alias("ingredients"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.lit("0")).when(k % 11 == 2, F.lit("500")).when(k % 11 == 3, F.lit("500.01"))
        .otherwise(F.col("p_size").cast("string")).cast("decimal(10,2)").alias("price"),
        F.when(k % 13 == 0, "usd").when(k % 13 == 1, "US$").when(k % 13 == 2, "éur").otherwise("USD").alias("currency"),
        F.lit("pending").alias("review_state"),
    )


_WORD_LIST = "[" + ", ".join(f"'{w}'" for w in INGREDIENT_WORDS) + "]"
_ALLERGEN_LIST = "[" + ", ".join(f"'{w}'" for w in ALLERGEN_CYCLE) + "]"

DISHES_SQL = f"""
dishes AS (
  SELECT k // 20 AS restaurant_id, CAST((k % 20) // 10 AS INTEGER) AS menu_pos,
    CAST((k % 10) // 5 AS INTEGER) AS category_pos, CAST(k % 5 AS INTEGER) AS pos, k AS dish_id,
    'menus[' || ((k % 20) // 10) || '].categories[' || ((k % 10) // 5) || '].dishes[' || (k % 5) || ']' AS path,
    CASE k % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || replace(p_name, ' ', '  ') ELSE p_name END AS name,
    CASE WHEN k % 5 = 0 THEN p_brand || '  of' || chr(9) || p_type || ' '
         WHEN k % 5 <> 4 THEN p_brand || ' ' || p_type END AS description,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_size || ' g' END AS serving_size,
    CASE WHEN k % 9 = 0 THEN NULL WHEN k % 23 = 0 THEN 5000 WHEN k % 29 = 0 THEN 5001
         ELSE p_size * 17 END::DECIMAL(12,3) AS calories,
    CASE WHEN k % 9 = 0 OR k % 8 = 0 THEN NULL ELSE p_size * 0.5 END::DECIMAL(12,3) AS protein_g,
    CASE WHEN k % 9 = 0 THEN NULL ELSE p_size * 2 END::DECIMAL(12,3) AS carbohydrates_g,
    CASE WHEN k % 9 = 0 THEN NULL ELSE k % 40 END::DECIMAL(12,3) AS fat_g,
    (k % 15)::DECIMAL(12,3) AS saturated_fat_g,
    CASE WHEN k % 3 = 0 THEN k % 21 END::DECIMAL(12,3) AS trans_fat_g,
    (k % 33)::DECIMAL(12,3) AS fiber_g, (k % 71)::DECIMAL(12,3) AS sugar_g,
    CASE WHEN k % 31 = 0 THEN 10000 WHEN k % 37 = 0 THEN 10000.5 ELSE p_size * 11 END::DECIMAL(12,3) AS sodium_mg,
    CASE WHEN k % 2 = 0 THEN [({_ALLERGEN_LIST})[k % 4 + 1]] ELSE []::VARCHAR[] END AS allergens,
    list_filter([({_WORD_LIST})[k % 7 + 1], ({_WORD_LIST})[(k + 2) % 7 + 1],
      CASE WHEN k % 3 = 0 THEN upper(({_WORD_LIST})[k % 7 + 1]) END,
      CASE WHEN k % 7 = 0 THEN ({_WORD_LIST})[(k + 1) % 7 + 1] END], lambda w: w IS NOT NULL) AS ingredients,
    CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 500 WHEN 3 THEN 500.01 ELSE p_size END::DECIMAL(10,2) AS price,
    CASE k % 13 WHEN 0 THEN 'usd' WHEN 1 THEN 'US$' WHEN 2 THEN 'éur' ELSE 'USD' END AS currency
  FROM (SELECT *, p_partkey AS k FROM part)
)"""

# White space in DuckDB's pattern language, matching functions.text.SPACE_RUN.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SQL_SPACE}', ' ', 'g'))"


def with_dishes(body: str) -> str:
    return f"WITH {DISHES_SQL} {body}"
