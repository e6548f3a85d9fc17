"""Entity schemas as Spark types, and the closed field lists records must meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
NUTRIENT = T.DecimalType(12, 3)

# Vocabularies.
ALLERGENS = ("milk", "eggs", "fish", "shellfish", "tree_nuts", "peanuts", "wheat", "soy", "sesame", "gluten")
REVIEW_STATES = ("pending", "confirmed", "rejected")
MACROS = (
    "calories", "protein_g", "carbohydrates_g", "fat_g", "saturated_fat_g",
    "trans_fat_g", "fiber_g", "sugar_g", "sodium_mg", "cholesterol_mg",
)
MICRONUTRIENTS = ("vitamin_a_mcg", "vitamin_c_mg", "vitamin_d_mcg", "calcium_mg", "iron_mg", "potassium_mg")
SOURCE_TYPES = ("restaurant_website", "third_party_menu_provider", "pdf_menu", "manual_entry")
CONTENT_TYPES = ("html", "pdf", "screenshot")
QUEUE_STATES = ("queued", "running", "succeeded", "failed")
RUN_STATES = ("pending", "running", "succeeded", "failed", "cancelled")
WORKFLOWS = ("collector_workflow", "reviewer_workflow")
CHANGE_STATES = ("pending", "approved", "rejected", "published")
DEFAULT_CURRENCY = "USD"
DEFAULT_MENU_NAME = "Menu"


def _struct(**types) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_S, _I, _L, _B, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)
_STRINGS = T.ArrayType(_S)

NUTRITION = _struct(
    serving_size=_S,
    macros=_struct(**{n: NUTRIENT for n in MACROS}),
    micronutrients=_struct(**{n: NUTRIENT for n in MICRONUTRIENTS}),
)
EXTRACTED_NUTRITION = _struct(
    serving_size=_S,
    macros=_struct(**{n: _D for n in MACROS}),
    micronutrients=_struct(**{n: _D for n in MICRONUTRIENTS}),
)
INGREDIENTS = T.ArrayType(_struct(name=_S, is_optional=_B))

RESTAURANT = _struct(
    id=_S, name=_S, description=_S, logo_url=_S, cover_image_url=_S, gallery_image_urls=_STRINGS,
    website_url=_S, cuisine_types=_STRINGS, is_active=_B, created_at=_TS, updated_at=_TS,
)
LOCATION = _struct(
    id=_S, restaurant_id=_S, label=_S, address_line1=_S, address_line2=_S, city=_S, state=_S,
    postal_code=_S, country=_S, latitude=_D, longitude=_D, phone=_S,
)
MENU = _struct(id=_S, restaurant_id=_S, pos=_I, name=_S)
CATEGORY = _struct(id=_S, menu_id=_S, parent_id=_S, pos=_I, name=_S, display_order=_I)
DISH = _struct(
    id=_S, category_id=_S, pos=_I, name=_S, description=_S, image_url=_S, nutrition=NUTRITION,
    allergens=_STRINGS, ingredients=INGREDIENTS, quantity=_S, price=MONEY, currency=_S, review_state=_S,
)
SOURCE = _struct(id=_S, restaurant_id=_S, source_type=_S, url=_S, is_verified_domain=_B, created_at=_TS)
SNAPSHOT = _struct(
    id=_S, source_id=_S, content_type=_S, content_hash=_S, storage_path=_S, fetched_at=_TS,
    http_status=_I, content_length_bytes=_L,
)
CANDIDATE = _struct(restaurant_id=_S, pos=_I, url=_S, provider_confidence=_D, provider_name=_S)
UPLOAD_ITEM = _struct(name=_S, menu_url=_S, nutrition_url=_S)
QUEUE_ITEM = _struct(
    id=_S, batch_id=_S, pos=_L, name=_S, menu_url=_S, nutrition_url=_S, status=_S,
    restaurant_seed_id=_S, error_message=_S, created_at=_TS, updated_at=_TS,
)
RUN = _struct(
    id=_S, workflow_type=_S, restaurant_id=_S, status=_S, started_at=_TS, completed_at=_TS,
    error_message=_S, metrics=T.MapType(_S, _S),
)
PROPOSED_CHANGE = _struct(
    id=_S, entity_type=_S, entity_id=_S, structured_json=_S, validation_result=_S, status=_S,
    agent_run_id=_S, source_id=_S, thread_id=_S, created_at=_TS, updated_at=_TS,
)
APPROVAL = _struct(
    id=_S, proposed_change_id=_S, decision=_S, reviewer_user_id=_S, reason=_S, decided_at=_TS
)
AUDIT_ENTRY = _struct(
    id=_S, action=_S, entity_type=_S, entity_id=_S, actor_id=_S, actor_email=_S, old_values=_S,
    new_values=_S, metadata=_S, agent_run_id=_S, created_at=_TS,
)
EXTRACTED_PROFILE = _struct(
    run_id=_S, description=_S, cuisine_types=_STRINGS, logo_url=_S, cover_image_url=_S, confidence=_D,
    source_snapshot_ids=_STRINGS,
)
EXTRACTED_DISH = _struct(
    run_id=_S, stub_pos=_I, pos=_I, name=_S, description=_S, image_url=_S, nutrition=EXTRACTED_NUTRITION,
    allergens=_STRINGS, ingredient_names=_STRINGS, quantity=_S, price=_D, currency=_S, confidence=_D,
    source_snapshot_ids=_STRINGS,
)


@dataclass(frozen=True)
class Rule:
    """One field of a closed record. ``name`` may be dotted for nested objects."""

    name: str
    type: str = "string"  # string, decimal, int, bool, array, object
    required: bool = False
    nullable: bool = True
    min_len: int | None = None
    max_len: int | None = None
    ge: float | None = None
    le: float | None = None
    one_of: tuple[str, ...] = ()
    items_of: tuple[str, ...] = ()
    not_blank: bool = False


@dataclass(frozen=True)
class Record:
    """A closed record: its own fields, and the arrays of records below it."""

    fields: tuple[Rule, ...]
    children: dict[str, "Record | str"] = field(default_factory=dict)

    def rules(self) -> tuple[Rule, ...]:
        return (*self.fields, *(Rule(n, "array", nullable=False) for n in self.children))


def _name(limit: int = 255) -> Rule:
    return Rule("name", required=True, nullable=False, min_len=1, max_len=limit, not_blank=True)


INGREDIENT_RECORD = Record((_name(), Rule("is_optional", "bool", nullable=False)))
DISH_RECORD = Record(
    (
        Rule("id", nullable=False),
        Rule("category_id", required=True, nullable=False),
        _name(),
        Rule("description", max_len=2000),
        Rule("image_url"),
        Rule("nutrition", "object", nullable=False),
        Rule("nutrition.serving_size"),
        Rule("nutrition.macros", "object", nullable=False),
        *(Rule(f"nutrition.macros.{n}", "decimal", ge=0) for n in MACROS),
        Rule("nutrition.micronutrients", "object", nullable=False),
        *(Rule(f"nutrition.micronutrients.{n}", "decimal", ge=0) for n in MICRONUTRIENTS),
        Rule("allergens", "array", nullable=False, items_of=ALLERGENS),
        Rule("quantity"),
        Rule("price", "decimal", ge=0),
        Rule("currency", nullable=False, min_len=3, max_len=3),
        Rule("review_state", nullable=False, one_of=REVIEW_STATES),
    ),
    {"ingredients": INGREDIENT_RECORD},
)
CATEGORY_RECORD = Record(
    (Rule("id", nullable=False), _name(), Rule("display_order", "int", nullable=False)),
    {"children": "self", "dishes": DISH_RECORD},
)
MENU_RECORD = Record(
    (Rule("id", nullable=False), Rule("name", nullable=False, min_len=1, max_len=255, not_blank=True)),
    {"categories": CATEGORY_RECORD},
)
LOCATION_RECORD = Record(
    (
        Rule("id", nullable=False),
        Rule("label"),
        Rule("address_line1", required=True, nullable=False, min_len=1, max_len=255, not_blank=True),
        Rule("address_line2", max_len=255),
        Rule("city", required=True, nullable=False, min_len=1, max_len=120, not_blank=True),
        Rule("state", max_len=120),
        Rule("postal_code", max_len=20),
        Rule("country", required=True, nullable=False, min_len=2, max_len=2),
        Rule("latitude", "decimal", ge=-90, le=90),
        Rule("longitude", "decimal", ge=-180, le=180),
        Rule("phone"),
    )
)
RESTAURANT_RECORD = Record(
    (
        Rule("id", nullable=False),
        _name(),
        Rule("description", max_len=2000),
        Rule("logo_url"),
        Rule("cover_image_url"),
        Rule("gallery_image_urls", "array", nullable=False),
        Rule("website_url"),
        Rule("cuisine_types", "array", nullable=False),
        Rule("is_active", "bool", nullable=False),
        Rule("created_at"),
        Rule("updated_at"),
    ),
    {"locations": LOCATION_RECORD, "menus": MENU_RECORD},
)
UPLOAD_RECORD = Record(
    (
        Rule("name", required=True, nullable=False, min_len=1, max_len=255),
        Rule("menu_url", required=True, nullable=False, min_len=1, max_len=2048),
        Rule("nutrition_url", required=True, nullable=False, min_len=1, max_len=2048),
    )
)
EXTRACTED_DISH_RECORD = Record(
    (
        _name(),
        Rule("description", max_len=2000),
        Rule("image_url"),
        Rule("nutrition", "object", nullable=False),
        Rule("nutrition.serving_size"),
        Rule("nutrition.macros", "object", nullable=False),
        *(Rule(f"nutrition.macros.{n}", "decimal", ge=0) for n in MACROS),
        Rule("nutrition.micronutrients", "object", nullable=False),
        *(Rule(f"nutrition.micronutrients.{n}", "decimal", ge=0) for n in MICRONUTRIENTS),
        Rule("allergens", "array", nullable=False, items_of=ALLERGENS),
        Rule("ingredient_names", "array", nullable=False),
        Rule("quantity"),
        Rule("price", "decimal", ge=0),
        Rule("currency", min_len=3, max_len=3),
        Rule("confidence", "decimal", ge=0, le=1),
        Rule("source_snapshot_ids", "array", nullable=False),
    )
)
EXTRACTED_PROFILE_RECORD = Record(
    (
        Rule("description", max_len=2000),
        Rule("cuisine_types", "array", nullable=False),
        Rule("logo_url"),
        Rule("cover_image_url"),
        Rule("confidence", "decimal", ge=0, le=1),
        Rule("source_snapshot_ids", "array", nullable=False),
    )
)
