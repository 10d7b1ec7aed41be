"""CSV, TSV, JSON, NDJSON and Parquet sources with schemas that are settled before a row is read.

A schema is inferred from a bounded sample, or given; then every value of every column, also of those that aren't
projected, must fit it. Text files are read as text columns and cast by the engine's own rules, so Spark's inference
and its lenient parsing play no part; the drift check is part of the scan, which fails at a value that doesn't fit.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.errors import Category, fail, raised, sanitised
from cleargrain.functions.expressions import quoted
from cleargrain.plans.types import BOOLEAN, FLOAT64, INT64, NULL, UINT64, UTF8, LogicalField, LogicalSchema, LogicalType, column_id, lub, schema_of, spark_type

#: Fixed limits: rows and bytes of a sample, by default and at most.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_SAMPLE_ROWS, MAX_SAMPLE_BYTES = 10_000, 8 << 20, 100_000, 64 << 20
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".parquet": "parquet"}
RAW = "__line"
INT64_RANGE, UINT64_MOST = (-(1 << 63), (1 << 63) - 1), (1 << 64) - 1
DATE = r"^\d{4}-\d{2}-\d{2}$"
NAIVE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"
ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+$"


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    sample_rows: int = SAMPLE_ROWS
    sample_bytes: int = SAMPLE_BYTES
    #: Whether cells may hold line breaks; None: found out by a scan.
    line_breaks: bool | None = None

    def __post_init__(self) -> None:
        if not (0 < self.sample_rows <= MAX_SAMPLE_ROWS and 0 < self.sample_bytes <= MAX_SAMPLE_BYTES):
            fail(Category.INVALID_REQUEST, "a sample is out of range")
        if len(self.delimiter) != 1 or len(self.quote) != 1 or self.delimiter == self.quote:
            fail(Category.INVALID_REQUEST, "a delimiter and a quote are single characters that differ")


@dataclass(frozen=True)
class Inspection:
    format: str
    schema: LogicalSchema
    sampled_rows: int
    findings: tuple[str, ...] = ()


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, kind in FORMATS.items():
        if name.endswith(suffix):
            return kind
    return fail(Category.UNSUPPORTED, "no such file format")


# --- inference


def cell_type(text: str) -> LogicalType:
    """The narrowest type of a CSV cell; dates are text."""
    if text == "":
        return NULL
    if text in ("true", "false"):
        return BOOLEAN
    if re.fullmatch(WHOLE, text):
        value = int(text)
        if INT64_RANGE[0] <= value <= INT64_RANGE[1]:
            return INT64
        if 0 <= value <= UINT64_MOST:
            return UINT64
    if re.fullmatch(NUMBER, text) and math.isfinite(float(text)):
        return FLOAT64
    return UTF8


def value_type(value: object, asset: str, path: str) -> LogicalType:
    """The type of a JSON value; a list's items and a struct's fields are merged."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INT64 if INT64_RANGE[0] <= value <= INT64_RANGE[1] else UINT64 if 0 <= value <= UINT64_MOST else FLOAT64
    if isinstance(value, float):
        return FLOAT64
    if isinstance(value, str):
        return UTF8
    if isinstance(value, list):
        item = NULL
        for v in value:
            item = merged(item, value_type(v, asset, path + "/item"))
        return LogicalType("list", item=item)
    return LogicalType("struct", fields=tuple(LogicalField(column_id(asset, f"{path}/{len(k)}:{k}"), k, t := value_type(v, asset, f"{path}/{len(k)}:{k}"), t == NULL) for k, v in value.items()))


def merged(a: LogicalType, b: LogicalType) -> LogicalType:
    """Null meets anything, numbers that differ become float64, structs merge by name; all else is drift."""
    if a == b:
        return a
    if a == NULL or b == NULL:
        return b if a == NULL else a
    if a.numeric and b.numeric:
        return FLOAT64
    if a.kind == b.kind == "list":
        return LogicalType("list", item=merged(a.item, b.item))
    if a.kind == b.kind == "struct":
        return LogicalType("struct", fields=merged_fields(a.fields, b.fields))
    return fail(Category.SCHEMA_DRIFT, "values of a column have no common type")


def merged_fields(a: tuple[LogicalField, ...], b: tuple[LogicalField, ...]) -> tuple[LogicalField, ...]:
    """a's fields, then b's new ones; a field that either lacks may be null."""
    others = {f.name: f for f in b}
    own = {f.name for f in a}
    out = [replace(f, type=merged(f.type, others[f.name].type), nullable=f.nullable or others[f.name].nullable) if f.name in others else replace(f, nullable=True) for f in a]
    return (*out, *(replace(f, nullable=True) for f in b if f.name not in own))


def _sample_lines(spark: SparkSession, path: str, options: Options, more: int) -> tuple[list[str], bool]:
    """First lines within the sample's bounds, and whether there are more. A quoted cell that the sample cuts off goes with its line."""
    rows = spark.read.text(path).select("value", F.is_valid_utf8("value")).limit(options.sample_rows + more + 1).toLocalIterator()
    out, size, cut = [], 0, False
    for text, valid in rows:
        if not valid:
            fail(Category.INVALID_DATA, "a file isn't UTF-8")
        size += len(text.encode()) + 1
        if len(out) == options.sample_rows + more or (size > options.sample_bytes and out):
            cut = True
            break
        out.append(text)
    quotes = [line.count(options.quote) for line in out]
    while cut and sum(quotes) % 2:
        out.pop()
        quotes.pop()
    return out, cut


def _spread(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether cells may go over several lines: some line has an odd number of quotes. Files that aren't UTF-8 are refused."""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2 == 1
    found = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8(value)).alias("invalid"), F.count_if(odd).alias("odd")).first()
    if found["invalid"]:
        fail(Category.INVALID_DATA, "a file isn't UTF-8")
    return found["odd"] > 0


def _refusing(df: DataFrame, bad: Column, category: Category, message: str) -> DataFrame:
    """The rows, or a failed run where they are read; a filter stays where columns are pruned, so there is no scan of its own."""
    return df.where(F.when(bad, raised(category, message).cast("boolean")).otherwise(True))


def _records(lines: list[str], options: Options, delimiter: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO("\n".join(lines).removeprefix("﻿")), delimiter=delimiter, quotechar=options.quote))


def _header(records: list[list[str]], options: Options) -> list[str]:
    if not records:
        return []
    if not options.header:
        return [f"column_{i + 1}" for i in range(len(records[0]))]
    names = records[0]
    if any(not n.strip() for n in names) or len(set(names)) < len(names):
        fail(Category.INVALID_DATA, "a header is blank or repeats")
    return names


def infer_delimited(spark: SparkSession, path: str, options: Options, delimiter: str) -> Inspection:
    lines, more = _sample_lines(spark, path, options, int(options.header))
    records = [r for r in _records(lines, options, delimiter) if r]
    names = _header(records, options)
    if not names:
        fail(Category.INVALID_DATA, "a file is empty")
    rows = records[int(options.header) :]
    types, empty = [NULL] * len(names), [not rows] * len(names)
    for row in rows:
        if len(row) != len(names):
            fail(Category.INVALID_DATA, "a row has the wrong number of cells")
        for i, cell in enumerate(row):
            t = cell_type(cell)
            types[i] = merged(types[i], t)
            empty[i] |= t == NULL
    fields = tuple(LogicalField(column_id(path, f"/{i}:{len(n)}:{n}"), n, t, e or t == NULL) for i, (n, t, e) in enumerate(zip(names, types, empty, strict=True)))
    return Inspection("csv", LogicalSchema(fields), len(rows), ("sample_truncated",) if more else ())


def _unique_pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len({k for k, _ in pairs}) < len(pairs):
        fail(Category.INVALID_DATA, "a JSON object repeats a key")
    return dict(pairs)


def _object(text: str) -> dict[str, object]:
    try:
        value = json.loads(text, object_pairs_hook=_unique_pairs, parse_constant=lambda _: fail(Category.INVALID_DATA, "a number isn't finite"))
    except ValueError:
        return fail(Category.INVALID_DATA, "a line isn't JSON")
    if not isinstance(value, dict):
        fail(Category.INVALID_DATA, "a row isn't a JSON object")
    return value


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row of JSON text for each object. A file that is one array is parsed by one task, as it has no lines to split at."""
    if kind == "ndjson":
        text = _refusing(spark.read.text(path), ~F.is_valid_utf8("value"), Category.INVALID_DATA, "a file isn't UTF-8")
        lines = text.select(F.regexp_replace("value", "^\ufeff", "").alias(RAW))
        return lines.where(F.length(F.trim(F.col(RAW))) > 0)
    whole = spark.read.option("wholetext", True).text(path).select(_one_value(F.regexp_replace("value", "^\ufeff", "")).alias("v"))
    framed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(raised(Category.INVALID_DATA, "a file is not one array of objects").cast("variant"))
    return whole.select(F.explode(framed.cast("array<variant>")).alias("v")).select(F.to_json("v").alias(RAW))


def _one_value(text: Column) -> Column:
    """The variant of a text that is exactly one JSON value, else null. Spark's parser stops after a value; in an array it can't."""
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit(",1]"))).cast("array<variant>")
    return F.when(F.size(held) == 2, held[0])


def infer_json(spark: SparkSession, path: str, options: Options, kind: str) -> Inspection:
    rows, size, more = [], 0, False
    for (line,) in json_lines(spark, path, kind).limit(options.sample_rows + 1).toLocalIterator():
        size += len(line.encode())
        if len(rows) == options.sample_rows or (size > options.sample_bytes and rows):
            more = True
            break
        rows.append(_object(line))
    if not rows:
        fail(Category.INVALID_DATA, "a file has no rows")
    fields: tuple[LogicalField, ...] | None = None
    for row in rows:
        own = value_type(row, path, "").fields
        fields = own if fields is None else merged_fields(fields, own)
    return Inspection(kind, LogicalSchema(fields), len(rows), ("sample_truncated",) if more else ())


def inspect(spark: SparkSession, path: str, options: Options | None = None, kind: str | None = None) -> Inspection:
    """The settled schema of a source."""
    options, kind = options or Options(), kind or format_of(path)
    with sanitised():
        if kind == "parquet":
            schema = spark.read.parquet(path).schema
            return Inspection(kind, schema_of(schema, path), 0)
        if kind in ("csv", "tsv"):
            return replace(infer_delimited(spark, path, options, "\t" if kind == "tsv" else options.delimiter), format=kind)
        return infer_json(spark, path, options, kind)


def overridden(found: LogicalSchema, given: LogicalSchema, kind: str) -> LogicalSchema:
    """A caller's schema keeps names and order; of a Parquet file it may only widen types and add nulls."""
    if [f.name for f in found.fields] != [f.name for f in given.fields]:
        fail(Category.SCHEMA_DRIFT, "a given schema has other columns")
    if kind == "parquet":
        for a, b in zip(found.fields, given.fields, strict=True):
            if lub(a.type, b.type) != b.type or (a.nullable and not b.nullable):
                fail(Category.SCHEMA_DRIFT, "a given schema is narrower than the file's")
    return given


# --- reading


def text_value(c: Column, t: LogicalType) -> Column:
    """A text cell as its type; null if it doesn't fit."""
    if t.kind == "null":
        return F.lit(None).cast("void")
    if t.kind == "utf8":
        return c
    if t.kind == "boolean":
        return F.when(c.isin("true", "false"), c == "true")
    if t.integer:
        wide = F.when(c.rlike(WHOLE), c.try_cast(T.DecimalType(38, 0)))
        low, high = (0, (1 << int(t.kind[4:])) - 1) if t.kind.startswith("u") else (-(1 << (int(t.kind[3:]) - 1)), (1 << (int(t.kind[3:]) - 1)) - 1)
        edge = lambda n: F.lit(str(n)).cast(T.DecimalType(38, 0))
        return F.when((wide >= edge(low)) & (wide <= edge(high)), wide.cast(spark_type(t)))
    if t.numeric:
        number = F.when(c.rlike(NUMBER), c.try_cast("double"))
        return F.when(F.abs(number) < float("inf"), number).cast(spark_type(t))
    if t.kind == "date32":
        return F.when(c.rlike(DATE), c.try_cast("date"))
    if t.kind == "timestamp":
        return F.when(c.rlike(NAIVE), c.try_cast("timestamp_ntz")) if t.timezone is None else F.when(c.rlike(ZONED), c.try_cast("timestamp"))
    return fail(Category.UNSUPPORTED, "a type can't be read from text")


def _typed(df: DataFrame, schema: LogicalSchema, check: bool) -> DataFrame:
    """Text columns cast; with check, a value that doesn't fit its type fails the run, in any column."""
    bad = []
    for f in schema.fields:
        c = quoted(f.name)
        wrong = F.lit(False) if f.type.kind == "utf8" else c.isNotNull() & text_value(c, f.type).isNull()
        bad.append(wrong if f.nullable else wrong | c.isNull())
    if check and bad:
        df = _refusing(df, reduce(Column.__or__, bad), Category.SCHEMA_DRIFT, "a value doesn't fit its column")
    return df.select(*[text_value(quoted(f.name), f.type).alias(f.name) for f in schema.fields])


def read_delimited(spark: SparkSession, path: str, schema: LogicalSchema, options: Options, delimiter: str, check: bool = True) -> DataFrame:
    """All cells as text first. A row of the wrong width fails the run, also where a column isn't used; so does a value that doesn't fit.

    A file with cells of several lines can't be split at lines, so one task reads it; other files are split.
    """
    names = [f.name for f in schema.fields]
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    spread = _spread(spark, path, options.quote) if options.line_breaks is None else options.line_breaks
    reader = spark.read.schema(texts).option("multiLine", spread).option("sep", delimiter).option("quote", options.quote).option("escape", options.quote).option("header", options.header)
    df = reader.option("mode", "FAILFAST").option("columnPruning", False).option("enforceSchema", True).option("emptyValue", "").option("nullValue", "").csv(path)
    first = F.regexp_replace(quoted(names[0]), "^\ufeff", "")
    df = df.withColumn(names[0], F.when(first != "", first))
    return _typed(df, schema, check)


def _json_value(v: Column, t: LogicalType) -> tuple[Column, Column]:
    """A variant's value as its type, and whether it fits."""
    kind = F.schema_of_variant(v)
    target = spark_type(t).simpleString()
    if t.kind == "null":
        return F.lit(None).cast("void"), kind == "VOID"
    if t.kind == "utf8":
        return F.try_variant_get(v, "$", "string"), kind == "STRING"
    if t.kind == "boolean":
        return F.try_variant_get(v, "$", "boolean"), kind == "BOOLEAN"
    if t.integer:
        value = text_value(F.try_variant_get(v, "$", "string"), t)
        return value, ((kind == "BIGINT") | kind.startswith("DECIMAL")) & value.isNotNull()
    if t.numeric:
        value = F.try_variant_get(v, "$", target)
        return value, ((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")) & value.isNotNull()
    if t.kind in ("date32", "timestamp"):
        value = text_value(F.try_variant_get(v, "$", "string"), t)
        return value, (kind == "STRING") & value.isNotNull()
    value = F.try_variant_get(v, "$", target)
    return value, value.isNotNull()


def read_json(spark: SparkSession, path: str, schema: LogicalSchema, kind: str, check: bool = True) -> DataFrame:
    """Objects as variants. Unknown and repeated keys, missing required fields and values that don't fit are drift."""
    rows = json_lines(spark, path, kind).select(RAW, _one_value(F.col(RAW)).alias("v"))
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    keys = F.json_object_keys(RAW)
    whole = F.col("v").isNotNull() & keys.isNotNull()
    bad = [~F.coalesce(whole, F.lit(False)) | (F.size(F.array_except(keys, names)) > 0) | (F.size(F.array_distinct(keys)) < F.size(keys))]
    columns = []
    for f in schema.fields:
        own = F.try_variant_get("v", "$['" + f.name.replace("'", "\\'") + "']", "variant")
        value, fits = _json_value(own, f.type)
        given = own.isNotNull() & (F.schema_of_variant(own) != "VOID")
        given = F.coalesce(given, F.lit(False))
        bad.append((given & ~F.coalesce(fits, F.lit(False))) | (~given if not f.nullable else F.lit(False)))
        columns.append(F.when(given, value).alias(f.name) if f.type.kind != "null" else F.lit(None).alias(f.name))
    if check:
        rows = _refusing(rows, reduce(Column.__or__, bad), Category.SCHEMA_DRIFT, "a row doesn't fit its schema")
    return rows.select(*columns)


def read(spark: SparkSession, path: str, projection: list[str] | None = None, schema: LogicalSchema | None = None, options: Options | None = None, kind: str | None = None, check: bool = True) -> tuple[DataFrame, LogicalSchema]:
    """The source's rows and schema, projected to some columns. Drift in any column, projected or not, fails where the rows are read."""
    options, kind = options or Options(), kind or format_of(path)
    found = inspect(spark, path, options, kind).schema if schema is None or kind == "parquet" else schema
    settled_schema = overridden(found, schema, kind) if schema is not None else found
    with sanitised():
        if kind == "parquet":
            df = spark.read.parquet(path)
            df = df.select(*[(quoted(f.name) if a.type == f.type else quoted(f.name).cast(spark_type(f.type))).alias(f.name) for a, f in zip(found.fields, settled_schema.fields, strict=True)])
        elif kind in ("csv", "tsv"):
            df = read_delimited(spark, path, settled_schema, options, "\t" if kind == "tsv" else options.delimiter, check)
        else:
            df = read_json(spark, path, settled_schema, kind, check)
    if projection is not None:
        fields = tuple(settled_schema.named(n) for n in projection)
        return df.select(*[quoted(n) for n in projection]), replace(settled_schema, fields=fields)
    return df, settled_schema
