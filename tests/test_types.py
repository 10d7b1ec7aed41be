"""Laws of the type lattice and of schemas."""

import itertools
from dataclasses import replace

import pytest

from cleargrain.errors import CleaningError
from cleargrain.plans.types import SIGNED, SIMPLE, UNSIGNED, LogicalField, LogicalSchema, LogicalType, lub, schema_of, simple, spark_type, timestamp

ALL = [simple(k) for k in SIMPLE] + [timestamp("millisecond"), timestamp("nanosecond"), timestamp(timezone="UTC"), LogicalType("list", item=simple("int32")), LogicalType("list", item=simple("int64"))]


def test_lub_is_commutative_and_idempotent():
    for a, b in itertools.product(ALL, ALL):
        assert lub(a, b) == lub(b, a)
    assert all(lub(a, a) == a for a in ALL)


def test_lub_is_associative_where_defined():
    for a, b, c in itertools.product(ALL, ALL, ALL):
        ab, bc = lub(a, b), lub(b, c)
        left, right = ab and lub(ab, c), bc and lub(a, bc)
        if left and right:
            assert left == right


@pytest.mark.parametrize(
    ("a", "b", "met"),
    [("int8", "int32", "int32"), ("uint8", "uint64", "uint64"), ("int64", "uint64", "float64"), ("int32", "float32", "float64"), ("float32", "float64", "float64"), ("null", "utf8", "utf8"), ("utf8", "int64", None), ("boolean", "int8", None)],
)
def test_lub_pairs(a, b, met):
    assert lub(simple(a), simple(b)) == (simple(met) if met else None)


def test_dates_and_timestamps_do_not_meet():
    assert lub(simple("date32"), timestamp()) is None
    assert lub(timestamp("second"), timestamp("nanosecond")).unit == "nanosecond"
    assert lub(timestamp(timezone="UTC"), timestamp()) is None


def test_structs_meet_by_position_and_name():
    f = LogicalField("a", "x", simple("int32"), False)
    a, b = LogicalType("struct", fields=(f,)), LogicalType("struct", fields=(replace(f, type=simple("int64"), nullable=True),))
    assert lub(a, b).fields[0].type == simple("int64") and lub(a, b).fields[0].nullable
    assert lub(a, LogicalType("struct", fields=(replace(f, name="y"),))) is None


def test_unsigned_types_take_wider_spark_types():
    assert [spark_type(simple(t)).simpleString() for t in UNSIGNED] == ["smallint", "int", "bigint", "decimal(20,0)"]
    assert [spark_type(simple(t)).simpleString() for t in SIGNED] == ["tinyint", "smallint", "int", "bigint"]


def test_schemas_are_checked():
    f = LogicalField("a", "x", simple("int64"))
    for bad in ((f, f), (f, replace(f, id="b")), (replace(f, name=" "),), (replace(f, metadata=(("api_key", "1"),)),)):
        with pytest.raises(CleaningError):
            LogicalSchema(bad)
    deep = simple("int8")
    for _ in range(70):
        deep = LogicalType("list", item=deep)
    with pytest.raises(CleaningError):
        LogicalSchema((LogicalField("a", "x", deep),))


def test_schema_round_trip(spark):
    schema = LogicalSchema((LogicalField("i", "n", simple("int64"), False), LogicalField("j", "s", LogicalType("list", item=simple("utf8")))))
    again = schema_of(schema.spark())
    assert [f.id for f in again.fields] == ["i", "j"] and [f.type for f in again.fields] == [f.type for f in schema.fields]
    assert schema.fingerprint() == schema.fingerprint() != again.fingerprint()[:1]
