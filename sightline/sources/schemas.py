"""JSON Schemas as predicates on variants, so that payloads are checked inside Spark's own plan.

Keywords: type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern,
format (date-time, date, email, uuid, ipv4, uri), items, minItems, maxItems, uniqueItems, properties, required,
minProperties, maxProperties, additionalProperties, oneOf, anyOf, allOf, not and $ref within the document. NOTES annotate
alone; any other keyword or format is an error while the predicate is built, so that no assertion passes without notice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import topic_regex

FORMATS = {
    "date-time": r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$",
    "date": r"^\d{4}-\d\d-\d\d$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$",
}
#: Keywords that say nothing about what fits.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "definitions", "$defs"}
KEYWORDS = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "items", "minItems",
    "maxItems", "uniqueItems", "properties", "required", "minProperties", "maxProperties", "additionalProperties", "oneOf", "anyOf", "allOf", "not", "$ref",
}
_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "null": "^VOID$"}


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _same(v: Column, value) -> Column:
    if value is None:
        return F.schema_of_variant(v) == "VOID"
    kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "double"
    name = {"boolean": "boolean", "string": "string", "double": "number"}[kind]
    return F.schema_of_variant(v).rlike(_TYPES[name]) & (_get(v, "$", kind) == F.lit(value))


def fits(v: Column, schema: dict | bool, root: dict | None = None) -> Column:
    """Whether a (present) variant fits a schema."""
    if isinstance(schema, bool):
        return F.lit(schema)
    root = schema if root is None else root
    if lost := set(schema) - KEYWORDS - NOTES:
        raise ValueError(f"keywords that can't be checked: {', '.join(sorted(lost))}")
    if "format" in schema and schema["format"] not in FORMATS:
        raise ValueError(f"format that can't be checked: {schema['format']}")
    if "$ref" in schema:
        target: dict = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part] if part else target
        return fits(v, target, root)
    kind = F.schema_of_variant(v)
    number, string = _get(v, "$", "double"), _get(v, "$", "string")
    whole = kind.rlike(_TYPES["number"]) & F.coalesce(number == F.floor(number), F.lit(False))  # 1.0 and 1e2 too
    is_a = lambda name: kind.rlike(_TYPES[name]) | whole if name == "integer" else kind.rlike(_TYPES[name])
    only = lambda name, test: ~is_a(name) | F.coalesce(test, F.lit(False))  # noqa: E731  a keyword binds values of its type
    tests = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        tests.append(reduce(lambda a, b: a | b, map(is_a, names)))
    if "enum" in schema:
        tests.append(reduce(lambda a, b: a | b, (_same(v, x) for x in schema["enum"])))
    if "const" in schema:
        tests.append(_same(v, schema["const"]))
    if "minimum" in schema:
        tests.append(only("number", number >= schema["minimum"]))
    if "maximum" in schema:
        tests.append(only("number", number <= schema["maximum"]))
    if "exclusiveMinimum" in schema:
        tests.append(only("number", number > schema["exclusiveMinimum"]))
    if "exclusiveMaximum" in schema:
        tests.append(only("number", number < schema["exclusiveMaximum"]))
    if "multipleOf" in schema:
        part = _get(v, "$", "decimal(38,12)") % F.lit(str(schema["multipleOf"])).cast("decimal(38,12)")
        tests.append(only("number", part == 0))
    if "minLength" in schema:
        tests.append(only("string", F.length(string) >= schema["minLength"]))
    if "maxLength" in schema:
        tests.append(only("string", F.length(string) <= schema["maxLength"]))
    for pattern in (schema.get("pattern"), FORMATS.get(schema.get("format", ""))):
        if pattern:
            tests.append(only("string", string.rlike(pattern)))
    items = _get(v, "$", "array<variant>")
    if "minItems" in schema:
        tests.append(only("array", F.size(items) >= schema["minItems"]))
    if "maxItems" in schema:
        tests.append(only("array", F.size(items) <= schema["maxItems"]))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        tests.append(only("array", F.size(F.array_distinct(texts)) == F.size(texts)))
    if "items" in schema:
        tests.append(only("array", F.forall(items, lambda x: fits(x, schema["items"], root))))
    named = schema.get("properties", {})
    child = lambda name: _get(v, f"$['{name}']", "variant")
    tests += [only("object", child(name).isNotNull()) for name in schema.get("required", ())]
    tests += [only("object", child(name).isNull() | fits(child(name), part, root)) for name, part in named.items()]
    size = F.size(_get(v, "$", "map<string,variant>"))
    if "minProperties" in schema:
        tests.append(only("object", size >= schema["minProperties"]))
    if "maxProperties" in schema:
        tests.append(only("object", size <= schema["maxProperties"]))
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.map_filter(_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*named) if named else F.lit(True))
        tests.append(only("object", (F.size(others) == 0) if more is False else F.forall(F.map_values(others), lambda x: fits(x, more, root))))
    for part in schema.get("allOf", ()):
        tests.append(fits(v, part, root))
    if "not" in schema:
        tests.append(~fits(v, schema["not"], root))
    if "anyOf" in schema:
        tests.append(reduce(lambda a, b: a | b, (fits(v, p, root) for p in schema["anyOf"])))
    if "oneOf" in schema:
        tests.append(reduce(lambda a, b: a + b, (fits(v, p, root).cast("int") for p in schema["oneOf"])) == 1)
    return F.coalesce(_all(tests), F.lit(False))


def valid(payload: Column, schema: dict) -> Column:
    """Whether a JSON text fits a schema; what is no JSON doesn't."""
    v = F.try_parse_json(payload)
    return F.when(v.isNull(), F.lit(False)).otherwise(fits(v, schema))


def by_topic(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages (topic, payload) with valid: whether the payload fits the schema of the first topic pattern that matches;
    a topic without a schema is never valid."""
    out = F.lit(False)
    for pattern, schema in reversed(schemas.items()):
        out = F.when(F.col("topic").rlike(topic_regex(pattern)), valid(F.col("payload"), schema)).otherwise(out)
    return messages.withColumn("valid", out)
