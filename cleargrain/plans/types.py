"""Logical types, their least upper bound, and schemas with column identities."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from cleargrain.errors import Category, fail, secret_key, secret_value

#: Fixed limits of schemas.
SCHEMA_VERSION, MAX_DEPTH, MAX_FIELDS, MAX_TEXT_BYTES = 1, 64, 4096, 1 << 20

SIGNED = ("int8", "int16", "int32", "int64")
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
FLOATS = ("float32", "float64")
UNITS = ("second", "millisecond", "microsecond", "nanosecond")
SIMPLE = ("null", "boolean", *SIGNED, *UNSIGNED, *FLOATS, "utf8", "binary", "date32")


@dataclass(frozen=True)
class LogicalType:
    """kind: one of SIMPLE, timestamp (unit, timezone), list (item) or struct (fields)."""

    kind: str
    unit: str | None = None
    timezone: str | None = None
    item: LogicalType | None = None
    fields: tuple[LogicalField, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.kind in SIGNED + UNSIGNED + FLOATS

    @property
    def integer(self) -> bool:
        return self.kind in SIGNED + UNSIGNED

    @property
    def ordered(self) -> bool:
        return self.numeric or self.kind in ("date32", "timestamp")

    @property
    def executable(self) -> bool:
        """Whether the engine computes with it; lists, structs and second timestamps only pass through connectors."""
        return self.kind not in ("list", "struct") and not (self.kind == "timestamp" and self.unit == "second")

    def json(self) -> object:
        if self.kind == "timestamp":
            return {"timestamp": {"unit": self.unit, "timezone": self.timezone}}
        if self.kind == "list":
            return {"list": self.item.json()}
        if self.kind == "struct":
            return {"struct": [f.json() for f in self.fields]}
        return self.kind


@dataclass(frozen=True)
class LogicalField:
    id: str
    name: str
    type: LogicalType
    nullable: bool = True
    metadata: tuple[tuple[str, str], ...] = ()

    def json(self) -> object:
        return {"id": self.id, "name": self.name, "type": self.type.json(), "nullable": self.nullable, "metadata": dict(self.metadata)}


def simple(kind: str) -> LogicalType:
    if kind not in SIMPLE:
        fail(Category.TYPE_ERROR, f"no type {kind}")
    return LogicalType(kind)


NULL, BOOLEAN, INT64, UINT64, FLOAT64, UTF8, BINARY, DATE32 = (simple(k) for k in ("null", "boolean", "int64", "uint64", "float64", "utf8", "binary", "date32"))


def timestamp(unit: str = "microsecond", timezone: str | None = None) -> LogicalType:
    if unit not in UNITS:
        fail(Category.TYPE_ERROR, f"no unit {unit}")
    return LogicalType("timestamp", unit, timezone)


def lub(a: LogicalType, b: LogicalType) -> LogicalType | None:
    """The least type that holds both, or None. Text meets nothing but text."""
    if a == b:
        return a
    if a.kind == "null":
        return b
    if b.kind == "null":
        return a
    for family in (SIGNED, UNSIGNED, FLOATS):
        if a.kind in family and b.kind in family:
            return a if family.index(a.kind) > family.index(b.kind) else b
    if a.numeric and b.numeric:
        return FLOAT64
    if a.kind == b.kind == "timestamp":
        return LogicalType("timestamp", UNITS[max(UNITS.index(a.unit), UNITS.index(b.unit))], a.timezone) if a.timezone == b.timezone else None
    if a.kind == b.kind == "list":
        item = lub(a.item, b.item)
        return LogicalType("list", item=item) if item else None
    if a.kind == b.kind == "struct" and len(a.fields) == len(b.fields):
        out = []
        for x, y in zip(a.fields, b.fields, strict=True):
            met = lub(x.type, y.type)
            if met is None or (x.id, x.name, x.metadata) != (y.id, y.name, y.metadata):
                return None
            out.append(replace(x, type=met, nullable=x.nullable or y.nullable))
        return LogicalType("struct", fields=tuple(out))
    return None


#: Spark's types of the logical ones. Unsigned types take the next wider signed one.
_TO_SPARK = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "binary": T.BinaryType(), "date32": T.DateType(),
}


def spark_type(t: LogicalType) -> T.DataType:
    if t.kind == "timestamp":
        return T.TimestampNTZType() if t.timezone is None else T.TimestampType()
    if t.kind == "list":
        return T.ArrayType(spark_type(t.item), True)
    if t.kind == "struct":
        return T.StructType([spark_field(f) for f in t.fields])
    return _TO_SPARK[t.kind]


def spark_field(f: LogicalField) -> T.StructField:
    return T.StructField(f.name, spark_type(f.type), f.nullable, {"column_id": f.id, "logical_type": json.dumps(f.type.json())})


_FROM_SPARK = {T.NullType: "null", T.BooleanType: "boolean", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "utf8", T.BinaryType: "binary", T.DateType: "date32"}


def logical_type(t: T.DataType, asset: str = "", path: str = "") -> LogicalType:
    if isinstance(t, T.TimestampNTZType):
        return timestamp()
    if isinstance(t, T.TimestampType):
        return timestamp(timezone="UTC")
    if isinstance(t, T.ArrayType):
        return LogicalType("list", item=logical_type(t.elementType, asset, path + "/item"))
    if isinstance(t, T.StructType):
        return LogicalType("struct", fields=tuple(field_of(f, asset, i, path) for i, f in enumerate(t.fields)))
    if isinstance(t, T.DecimalType) and (t.precision, t.scale) == (20, 0):
        return UINT64
    kind = _FROM_SPARK.get(type(t))
    if kind is None:
        fail(Category.UNSUPPORTED, f"the type {t.simpleString()} isn't supported")
    return simple(kind)


def column_id(asset: str, path: str) -> str:
    """A stable identity of a file's column."""
    return str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, asset or "asset"), path))


def field_of(f: T.StructField, asset: str, position: int, path: str = "") -> LogicalField:
    own = f"{path}/{position}:{len(f.name)}:{f.name}"
    return LogicalField((f.metadata or {}).get("column_id") or column_id(asset, own), f.name, logical_type(f.dataType, asset, own), f.nullable)


@dataclass(frozen=True)
class LogicalSchema:
    fields: tuple[LogicalField, ...]
    metadata: tuple[tuple[str, str], ...] = field(default=())
    version: int = SCHEMA_VERSION

    def __post_init__(self) -> None:
        if self.version != SCHEMA_VERSION:
            fail(Category.INVALID_PLAN, "no such schema version")
        stack, count, text = [(self.fields, 1)], 0, 0
        while stack:
            fields, depth = stack.pop()
            if depth > MAX_DEPTH:
                fail(Category.LIMIT_EXCEEDED, "the schema is nested too deeply")
            for values, what in (([f.id for f in fields], "ids"), ([f.name for f in fields], "names")):
                if len(set(values)) < len(values):
                    fail(Category.INVALID_PLAN, f"column {what} repeat")
            for f in fields:
                count += 1
                text += len(f.name.encode()) + sum(len(k.encode()) + len(v.encode()) for k, v in f.metadata)
                if not f.name.strip():
                    fail(Category.INVALID_PLAN, "a column name is blank")
                if secret_value(f.name) or any(secret_key(k) or secret_value(v) for k, v in f.metadata):
                    fail(Category.INVALID_PLAN, "a column's name or metadata looks like a secret")
                t = f.type
                while t.kind == "list":
                    t, depth = t.item, depth + 1
                    if depth > MAX_DEPTH:
                        fail(Category.LIMIT_EXCEEDED, "the schema is nested too deeply")
                if t.kind == "struct":
                    stack.append((t.fields, depth + 1))
        if count > MAX_FIELDS or text > MAX_TEXT_BYTES:
            fail(Category.LIMIT_EXCEEDED, "the schema is too large")

    def by_id(self, id: str) -> LogicalField:
        for f in self.fields:
            if f.id == id:
                return f
        return fail(Category.INVALID_PLAN, "no such column id")

    def named(self, name: str) -> LogicalField:
        for f in self.fields:
            if f.name == name:
                return f
        return fail(Category.INVALID_PLAN, "no such column name")

    def spark(self) -> T.StructType:
        return T.StructType([spark_field(f) for f in self.fields])

    def json(self) -> object:
        return {"version": self.version, "fields": [f.json() for f in self.fields], "metadata": dict(self.metadata)}

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.json(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def schema_of(spark_schema: T.StructType, asset: str = "") -> LogicalSchema:
    return LogicalSchema(tuple(field_of(f, asset, i) for i, f in enumerate(spark_schema.fields)))
