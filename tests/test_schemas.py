"""Keywords of JSON Schemas, each with texts that fit and texts that don't."""

import pytest
from pyspark.sql import functions as F

from sightline.sources import schemas

CASES = [
    ({"type": "integer"}, ["1", "-3", "1.0", "1e2", "12345678901234567890"], ["1.5", '"1"', "true", "null", "{}"]),
    ({"type": "number"}, ["1", "2.5", "1e-3"], ['"2"', "[]"]),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1"]),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 10}, ["1", "9.99", '"x"'], ["0", "10", "-1"]),
    ({"multipleOf": 0.1}, ["0.3", "2", "0"], ["0.35"]),
    ({"uniqueItems": True}, ["[]", "[1,2]", '[{"a":1},{"a":2}]', "3"], ["[1,1]", '[{"a":1},{"a":1}]']),
    ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}', '{"a":1,"b":2}', "7"], ["{}", '{"a":1,"b":2,"c":3}']),
    ({"not": {"type": "string"}}, ["1"], ['"a"']),
    ({"format": "uri"}, ['"https://a.b/c?d=e"', '"urn:x:1"', "1"], ['"a b"', '"/path"', '"http:"']),
    ({"format": "uuid"}, ['"123e4567-e89b-12d3-a456-426614174000"'], ['"123"']),
    ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, ["1", "5.5"], ["6", "2.5"]),
    ({"properties": {"a": {"$ref": "#/$defs/n"}}, "required": ["a"], "additionalProperties": False, "$defs": {"n": {"minimum": 2}}, "title": "t"}, ['{"a":2}', "1"], ["{}", '{"a":1}', '{"a":2,"b":1}']),
]


@pytest.mark.parametrize(("schema", "good", "bad"), CASES, ids=[next(iter(c[0])) for c in CASES])
def test_keywords(spark, schema, good, bad):
    df = spark.createDataFrame([(t,) for t in [*good, *bad, "no json", None]], "p string")
    got = {r.p: r.ok for r in df.select("p", schemas.valid(F.col("p"), schema).alias("ok")).collect()}
    assert got == dict.fromkeys(good, True) | dict.fromkeys([*bad, "no json", None], False)


@pytest.mark.parametrize("schema", [{"patternProperties": {}}, {"items": {"contains": {}}}, {"format": "iri"}, {"allOf": [{"if": {}}]}])
def test_what_cannot_be_checked_is_an_error(spark, schema):
    with pytest.raises(ValueError, match="can't be checked"):
        schemas.valid(F.col("p"), schema)
