"""Closed-schema conformance of JSON records, and precondition gates."""

from __future__ import annotations

import json as json_text
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.let import let
from ..functions.text import strip_space
from ..schema import Record, Rule
from .groups import join_keys

CODE = "schema_violation"
Decode = Callable[[str, int], tuple[object, int]]
Test = Callable[[dict, str, list[tuple[str, str, str]]], None]
# Words taken as booleans, whatever their case.
BOOL_WORDS = ("true", "false", "1", "0", "yes", "no", "on", "off", "y", "n", "t", "f")

# Message texts.
MISSING = "Field required"
EXTRA = "Extra inputs are not permitted"
TYPE_TEXT = {
    "string": "Input should be a valid string",
    "decimal": "Input should be a valid number",
    "int": "Input should be a valid integer",
    "bool": "Input should be a valid boolean",
    "array": "Input should be a valid list",
    "object": "Input should be a valid dictionary",
}


def _characters(n: int) -> str:
    return f"{n} character" + ("" if n == 1 else "s")


def _limit_text(rule: Rule, limit: str) -> str:
    """Message of a value beyond one of its rule's limits."""
    value = getattr(rule, limit)
    return {
        "min_len": lambda: f"String should have at least {_characters(value)}",
        "max_len": lambda: f"String should have at most {_characters(value)}",
        "ge": lambda: f"Input should be greater than or equal to {value:g}",
        "le": lambda: f"Input should be less than or equal to {value:g}",
        "one_of": lambda: "Input should be one of " + ", ".join(value),
        "items_of": lambda: "Input should be one of " + ", ".join(value),
        "not_blank": lambda: "Value error, this field cannot be blank",
    }[limit]()


def _finite(text: Column) -> Column:
    value = text.try_cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _right_type(rule: Rule, kind: Column, text: Column) -> Column:
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    if rule.type == "string":
        return kind == "STRING"
    if rule.type == "decimal":
        return number | ((kind == "STRING") & _finite(text))
    if rule.type == "int":
        return (number | (kind == "STRING")) & F.coalesce(
            _finite(text) & (text.try_cast("double") == F.floor(text.try_cast("double"))), F.lit(False)
        )
    if rule.type == "bool":
        return (kind == "BOOLEAN") | F.lower(text).isin(*BOOL_WORDS)
    return F.startswith(kind, F.lit("ARRAY" if rule.type == "array" else "OBJECT"))


def _kind(rule: Rule, value: Column, doc: Column) -> Column:
    """The type of a value. Of lists and objects only that they are such: their whole schema takes
    a walk through all that is below them."""
    if rule.type not in ("array", "object"):
        return F.schema_of_variant(value)
    wanted, name = ("array<variant>", "ARRAY") if rule.type == "array" else ("map<string,variant>", "OBJECT")
    fits = F.try_variant_get(doc, "$." + rule.name, wanted).isNotNull()
    return F.when(F.is_variant_null(value), "VOID").when(fits, name).otherwise("OTHER")


def _problem(rule: Rule, doc: Column, present: Column) -> Column:
    """Message of the first constraint a field breaks; null when it meets all."""
    path = "$." + rule.name
    text = F.lit(None).cast("string") if rule.type in ("array", "object") else F.try_variant_get(doc, path, "string")
    seen = F.struct(_kind(rule, F.variant_get(doc, path, "variant"), doc).alias("kind"), text.alias("text"), present.alias("present"))
    return let(seen, lambda s: _first_broken(rule, doc, s["kind"], s["text"], s["present"]))


def _first_broken(rule: Rule, doc: Column, kind: Column, text: Column, present: Column) -> Column:
    number = text.try_cast("double")
    tests: list[tuple[Column, Column | str]] = []
    null = present & (kind == "VOID")
    if rule.required:
        tests.append((~present, MISSING))
    if not rule.nullable:
        tests.append((null, TYPE_TEXT[rule.type]))
    filled = present & (kind != "VOID")
    tests.append((filled & ~_right_type(rule, kind, text), TYPE_TEXT[rule.type]))
    if rule.min_len is not None:
        tests.append((filled & (F.length(text) < rule.min_len), _limit_text(rule, "min_len")))
    if rule.max_len is not None:
        tests.append((filled & (F.length(text) > rule.max_len), _limit_text(rule, "max_len")))
    if rule.ge is not None:
        tests.append((filled & (number < rule.ge), _limit_text(rule, "ge")))
    if rule.le is not None:
        tests.append((filled & (number > rule.le), _limit_text(rule, "le")))
    if rule.one_of:
        tests.append((filled & ~text.isin(*rule.one_of), _limit_text(rule, "one_of")))
    if rule.items_of:
        items = F.try_variant_get(doc, "$." + rule.name, "array<string>")
        known = F.array(*[F.lit(v) for v in rule.items_of])
        tests.append((F.size(F.array_except(items, known)) > 0, _limit_text(rule, "items_of")))
    if rule.not_blank:
        tests.append((filled & (strip_space(text) == ""), _limit_text(rule, "not_blank")))
    return reduce(lambda acc, t: acc.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))


def _unknown_keys(keys: Column, prefix: str) -> Column:
    return F.transform(
        keys, lambda k: F.struct(F.concat(F.lit(prefix), k).alias("path"), F.lit(EXTRA).alias("message"))
    )


def _by_object(record: Record) -> dict[str, list[Rule]]:
    """The rules of each object of a record, by its place; "" is the record itself."""
    out: dict[str, list[Rule]] = {"": []}
    for rule in record.rules():
        out.setdefault(rule.name.rpartition(".")[0], []).append(rule)
    return out


def _asks(by_object: dict[str, list[Rule]], parent: str) -> bool:
    """Whether an object that is absent lacks a required field, its own or below it."""
    return any(r.required for p, rules in by_object.items() if p == parent or p.startswith(parent + ".") for r in rules)


def _record_problems(record: Record, json: Column) -> Column:
    """All violations of one record as array<struct<path, message>>. The text is
    parsed once; the keys of each object in it are read once."""
    by_object = _by_object(record)
    empty, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<path:string,message:string>>")

    def object_problems(doc: Column, parent: str) -> Column:
        prefix, rules = parent + "." if parent else "", by_object[parent]
        node = F.get_json_object(json, "$." + parent) if parent else json
        allowed = F.array(*[F.lit(r.name.rpartition(".")[2]) for r in rules])

        def with_keys(keys: Column) -> Column:
            has = lambda path: F.array_contains(keys, path.rpartition(".")[2])
            found = []
            for rule in rules:
                # A field that is absent and may be so breaks no rule.
                problem = _when_given(rule.name, _problem(rule, doc, has(rule.name) if rule.required else F.lit(True)))
                found.append(problem if rule.required else F.when(has(rule.name), problem))
            below = [
                object_problems(doc, p) if _asks(by_object, p) else F.when(has(p), object_problems(doc, p)).otherwise(nothing)
                for p in by_object if p and p.rpartition(".")[0] == parent
            ]
            return F.concat(F.array(*found), _unknown_keys(F.array_except(keys, allowed), prefix), *below)

        return let(F.coalesce(F.json_object_keys(node), empty), with_keys)

    def problems(doc: Column) -> Column:
        is_object = doc.isNotNull() & json.rlike("^\\uFEFF?[ \\t\\n\\r]*\\{")
        loose = [p for p in by_object if p and p.rpartition(".")[0] not in by_object]
        found = F.concat(*[object_problems(doc, p) for p in ["", *loose]])
        root = F.array(_at("<root>", F.lit(TYPE_TEXT["object"])))
        return F.when(is_object, F.array_compact(found)).otherwise(root)

    return let(F.try_parse_json(json), problems)


def _when_given(path: str, message: Column) -> Column:
    return let(message, lambda m: F.when(m.isNotNull(), _at(path, m)))


def _at(path: str, message: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), message.alias("message"))


def _issue_rows(records: DataFrame, problems: Column, keys: list[str]) -> DataFrame:
    path = F.concat(F.col("_at"), F.when(F.col("_at") != "", ".").otherwise(""), F.col("_p.path"))
    return (
        records.withColumn("_p", F.explode(problems))
        .select(
            *keys,
            F.when(F.col("_p.path") == "<root>", F.when(F.col("_at") != "", F.col("_at")).otherwise("<root>"))
            .otherwise(path).alias("field_path"),
            F.lit(CODE).alias("code"), F.lit("error").alias("severity"), F.col("_p.message").alias("message"),
        )
    )


def _kinds(record: Record) -> list[Record]:
    """The record and all kinds of records below it, each once."""
    out = [record]
    for kind in out:
        for child in kind.children.values():
            if child != "self" and not any(child is k for k in out):
                out.append(child)
    return out


def _decoder(**hooks) -> Decode:
    """The value at a place of a text and the place behind it. Words that are no JSON are errors."""

    def refuse(word: str) -> None:
        raise ValueError(word)

    return json_text.JSONDecoder(parse_constant=refuse, **hooks).raw_decode


_SKIP = re.compile(r"[ \t\n\r]*").match


def _elements(decode: Decode, text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the elements of the list that begins at ``at``."""
    at = _SKIP(text, at + 1).end()
    while at < end and text[at] != "]":
        _, stop = decode(text, at)
        yield at, stop
        at = _SKIP(text, stop).end()
        at = _SKIP(text, at + 1).end() if text[at] == "," else at


def _members(decode: Decode, text: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(key, start, end) of the members of the object that begins at ``at``."""
    at = _SKIP(text, at + 1).end()
    while at < end and text[at] != "}":
        key, stop = decode(text, at)
        start = _SKIP(text, _SKIP(text, stop).end() + 1).end()
        _, stop = decode(text, start)
        yield key, start, stop
        at = _SKIP(text, stop).end()
        at = _SKIP(text, at + 1).end() if text[at] == "," else at


def nested_records(decode: Decode, text: str | None, below: Sequence[dict[str, int]]) -> list[tuple[int, str, str | None]]:
    """(kind, place, text) of a record and of all records below it. ``below`` has for each kind the kind
    of the records in each of its lists. Texts are cut out as they stand. A text that is no JSON, or
    an object that repeats a key, holds no records."""
    out: list[tuple[int, str, str | None]] = [(0, "", text)]
    try:
        start = _SKIP(text or "").end()
        _, end = decode(text or "", start)
        todo = [(0, "", start, end)] if not (text or "")[end:].strip(" \t\n\r") else []
    except (ValueError, RecursionError):
        todo = []
    names = [[json_text.dumps(name) for name in lists] for lists in below]
    plain = "\\" not in (text or "")
    while todo:
        kind, place, start, end = todo.pop()
        # Without escapes a list's name stands in the text as it is.
        if text[start] != "{" or plain and all(text.find(name, start, end) < 0 for name in names[kind]):
            continue
        members = list(_members(decode, text, start, end))
        if len({m[0] for m in members}) < len(members):
            continue
        for name, a, b in members:
            if name in below[kind] and text[a] == "[":
                for i, (c, d) in enumerate(_elements(decode, text, a, b)):
                    at = f"{place}.{name}.{i}" if place else f"{name}.{i}"
                    out.append((below[kind][name], at, text[c:d]))
                    todo.append((below[kind][name], at, c, d))
    return out


# Beyond these the parser of the expressions may refuse what Python's takes.
_MAX_TEXT, _MAX_KEY, _MAX_DEPTH, _MAX_NUMBER = 1_000_000, 50_000, 500, 1e15
_MANY_DIGITS = re.compile(r"[0-9]{300}").search
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]").search
_PLAIN_NUMBER = re.compile(r"-?[0-9]{1,15}(\.[0-9]{1,15})?").fullmatch


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _once_and_short(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if any(len(key) >= _MAX_KEY for key, _ in pairs):
        raise ValueError("long key")
    return _once(pairs)


def _sure(fact: bool) -> bool:
    if not fact:
        raise ValueError("only the expressions tell")
    return True


def _too_deep(value: object) -> bool:
    layer, depth = [value], 0
    while layer and depth <= _MAX_DEPTH:
        layer = [x for v in layer if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
    return depth > _MAX_DEPTH


def _value_test(rule: Rule) -> Callable[[object], str | None]:
    """What ``_first_broken`` says of a field that is there, for a decoded value. Values that the
    expressions read in ways of their own are errors."""
    wrong = TYPE_TEXT[rule.type]
    null = None if rule.nullable else wrong
    least, most, words, items, whole = rule.ge, rule.le, rule.one_of, frozenset(rule.items_of), rule.type == "int"
    least_len, most_len = rule.min_len or 0, _MAX_TEXT if rule.max_len is None else rule.max_len
    limits = {n: getattr(rule, n) for n in ("min_len", "max_len", "ge", "le", "one_of", "items_of", "not_blank")}
    says = {n: _limit_text(rule, n) for n, x in limits.items() if x is not None and x is not False and x != ()}
    blank = says.get("not_blank")

    def any_text(value: object) -> str | None:
        return None if type(value) is str else null if value is None else wrong

    def text(value: object) -> str | None:
        if type(value) is not str:
            return null if value is None else wrong
        if not least_len <= len(value) <= most_len:
            return says["min_len"] if len(value) < least_len else says["max_len"]
        if words and value not in words:
            return says["one_of"]
        return blank if blank is not None and not value.strip() else None

    def number(value: object) -> str | None:
        if type(value) is str:
            value = float(_sure(_PLAIN_NUMBER(value) is not None) and value)
        elif type(value) is not int and type(value) is not float:
            return null if value is None else wrong
        _sure(-_MAX_NUMBER < value < _MAX_NUMBER)
        if whole and value != int(value):
            return wrong
        if least is not None and value < least:
            return says["ge"]
        return says["le"] if most is not None and value > most else None

    def boolean(value: object) -> str | None:
        if value is None or type(value) is bool:
            return null if value is None else None
        _sure(type(value) is str or type(value) is int)
        return None if str(value).lower() in BOOL_WORDS else wrong

    def listed(value: object) -> str | None:
        if type(value) is not list:
            return null if value is None else wrong
        if items and _sure(all(type(x) is str for x in value)) and not items.issuperset(value):
            return says["items_of"]
        return None

    def inner(value: object) -> str | None:
        _sure(type(value) is dict)
        return None

    test, fits = {
        "string": (text if says else any_text, {"min_len", "max_len", "one_of", "not_blank"}), "decimal": (number, {"ge", "le"}),
        "int": (number, {"ge", "le"}), "bool": (boolean, set()), "array": (listed, {"items_of"}), "object": (inner, set()),
    }[rule.type]
    return test if says.keys() <= fits else lambda value: _sure(False)


def _object_test(by_object: dict[str, list[Rule]], parent: str, lists: Sequence[tuple[str, int]], tests: list[Test]) -> Test:
    """A function that adds (place with a dot behind it, path, message) of all that an object, those below it and
    the records in its lists break. ``lists`` has the place of each list's test in ``tests``."""
    prefix, last = parent + "." if parent else "", lambda path: path.rpartition(".")[2]
    fields = {last(r.name): _value_test(r) for r in by_object[parent]}
    required = [last(r.name) for r in by_object[parent] if r.required]
    inner = [(last(p), _object_test(by_object, p, (), tests), _asks(by_object, p)) for p in by_object if p and p.rpartition(".")[0] == parent]
    root = TYPE_TEXT["object"]

    def test(value: dict, place: str, found: list[tuple[str, str, str]]) -> None:
        for key, of in value.items():
            if key in fields:
                message = fields[key](of)
                if message is not None:
                    found.append((place, prefix + key, message))
            else:
                found.append((place, prefix + key, EXTRA))
        for key in required:
            if key not in value:
                found.append((place, prefix + key, MISSING))
        for key, below, asks in inner:
            if key in value:
                below(_sure(type(value[key]) is dict) and value[key], place, found)
            elif asks:
                below({}, place, found)
        for key, kind in lists:
            if key in value and type(value[key]) is list:
                below = tests[kind]
                for i, item in enumerate(value[key]):
                    at = f"{place}{key}.{i}."
                    if type(item) is dict:
                        below(item, at, found)
                    else:
                        found.append((at, "<root>", root))

    return test


def _record_tests(kinds: Sequence[Record], below: Sequence[dict[str, int]]) -> list[Test]:
    tests: list[Test] = []
    for kind, lists in zip(kinds, below, strict=True):
        by_object = _by_object(kind)
        loose = any(p and p.rpartition(".")[0] not in by_object for p in by_object)
        tests.append((lambda value, place, found: _sure(False)) if loose else _object_test(by_object, "", tuple(lists.items()), tests))
    return tests


def plain_problems(text: str | None, test: Test, decode: Decode, decode_long: Decode) -> list[tuple[str, str, str]] | None:
    """(place with a dot behind it, path, message) of all violations of a record and of all records below it, by its
    kind's ``test``; None for a text that Python and the expressions might read in different ways."""
    try:
        if text is None or len(text) > _MAX_TEXT or len(text) > 300 and _MANY_DIGITS(text):
            return None
        value, end = (decode_long if len(text) > _MAX_KEY else decode)(text, _SKIP(text).end())
        if end < len(text) and _SKIP(text, end).end() < len(text):
            return None
        if "\\u" in text and _SURROGATE(text):
            json_text.dumps(value, ensure_ascii=False).encode()  # a lone half is an error
        if text.count("[") + text.count("{") > _MAX_DEPTH and _too_deep(value):
            return None
        if type(value) is not dict:
            return [("", "<root>", TYPE_TEXT["object"])]
        found: list[tuple[str, str, str]] = []
        test(value, "", found)
        return found
    except (ValueError, RecursionError):
        return None


def schema_issues(df: DataFrame, keys: list[str], json: str, record: Record) -> DataFrame:
    """One row per offending field of every record, arrays of records included, at
    any depth. One pass decodes each text and tests all its records by the rules of their kinds.
    Texts that Python may read differently are taken apart into their records instead, and one
    expression tests each; nothing is shuffled or written."""
    kinds = _kinds(record)
    place = lambda kind, child: next(i for i, k in enumerate(kinds) if k is (kind if child == "self" else child))
    below = [{name: place(kind, child) for name, child in kind.children.items()} for kind in kinds]
    source = df.select(*keys, F.col(json).cast("string").alias("_text"))
    added = (("_kind", T.IntegerType()), ("_at", T.StringType()), ("_json", T.StringType()), ("_path", T.StringType()), ("_message", T.StringType()))
    schema = T.StructType([*(source.schema[k] for k in keys), *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, plain, plain_long = _decoder(), _decoder(object_pairs_hook=_once), _decoder(object_pairs_hook=_once_and_short)
        test = _record_tests(kinds, below)[0]
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                problems = plain_problems(text, test, plain, plain_long)
                if problems is None:
                    found += [(i, *node, None, None) for node in nested_records(decode, text, below)]
                else:
                    found += [(i, -1, at[:-1], None, path, message) for at, path, message in problems]
            rows, kind, *texts = zip(*found, strict=True) if found else [()] * 6
            own = batch.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(kind, pa.int32()), *(pa.array(x, pa.string()) for x in texts)], [*keys, *(n for n, _ in added)]
            )

    nodes = source.mapInArrow(run, schema)
    problems = reduce(
        lambda acc, i: acc.when(F.col("_kind") == i, _record_problems(kinds[i], F.col("_json"))),
        range(len(kinds)), F.when(F.col("_kind") == -1, F.array(F.struct(F.col("_path").alias("path"), F.col("_message").alias("message")))),
    )
    return _issue_rows(nodes, problems, keys)


def flat_schema_issues(df: DataFrame, keys: list[str], json: str, record: Record) -> DataFrame:
    """``schema_issues`` for records without arrays of records: a single pass."""
    return _issue_rows(df.select(*keys, F.lit("").alias("_at"), F.col(json).alias("_json")), _record_problems(record, F.col("_json")), keys)


def conforming(df: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Records without any violation; only these go on to the other rules."""
    return join_keys(df, issues.select(*keys).distinct(), keys, "left_anti")


def gate(df: DataFrame, stage: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may go on, error rows). A row that lacks a required input
    leaves the pipeline with the names of what is missing."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull()
    )
    checked = df.withColumn("_missing", missing)
    passed = checked.filter(F.size("_missing") == 0).drop("_missing")
    errors = (
        checked.filter(F.size("_missing") > 0)
        .withColumn("stage", F.lit(stage))
        .withColumn("error_message", F.concat(F.array_join("_missing", "/"), F.lit(" required before "), F.lit(stage)))
        .drop("_missing")
    )
    return passed, errors
