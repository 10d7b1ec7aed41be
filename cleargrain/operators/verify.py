"""Verification runs: every source row is accepted, rejected or dropped, and reports say why.

Rows are routed in one frame. It carries the scanned row, its ordinal, whether it is still alive, what ended it, and the
findings of the rules that it failed; the five results are selections of it. Validation costs no shuffle. Each
deduplication rule sums up first ordinals by key and joins them back, so a key that many rows share is summed before it
is shuffled, and its join can be split.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.errors import Category, fail, raised
from cleargrain.functions.expressions import predicate, quoted
from cleargrain.operators.compile import Sources, scan
from cleargrain.operators.rules import schema_after, value_after
from cleargrain.plans.model import ApplyRules, Deduplicate, DropColumn, Filter, FilterRows, Materialize, Plan, Project, Rename, Scan, Validate
from cleargrain.plans.types import LogicalSchema, LogicalType
from cleargrain.workspace import local_rows, settled

#: Fixed limits of verification.
MAX_FINDINGS, MAX_KEY_BYTES = 256, 64 << 10
FINDING = "array<struct<node_id:string,rule_ordinal:int,severity:string,predicate_outcome:string>>"
DUPLICATE = "array<struct<node_id:string,rule_ordinal:int,first_source_row_ordinal:bigint,key_column_count:int,encoded_key_byte_count:bigint>>"
ENDED = "struct<rejection_kind:string,node_id:string,rule_ordinal:int>"
#: Bytes of a key value after its tag.
WIDTHS = {"boolean": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float32": 4, "date32": 4, "int64": 8, "uint64": 8, "float64": 8, "timestamp": 8}


@dataclass(frozen=True)
class Provenance:
    """What every report row says of its run."""

    input_kind: str = "source_asset"
    input_id: str = ""
    input_version_digest: str = ""
    plan_fingerprint: str = ""
    canonical_plan_digest: str = ""

    def columns(self) -> list[Column]:
        return [F.lit(getattr(self, n)).alias(n) for n in ("input_kind", "input_id", "input_version_digest", "plan_fingerprint", "canonical_plan_digest")]


@dataclass(frozen=True)
class Verified:
    """accepted rows and the reports; rejected is None if no rule can reject a row."""

    accepted: DataFrame
    schema: LogicalSchema
    validation_summary: DataFrame
    validation_findings: DataFrame
    rejected: DataFrame | None
    dedup_summary: DataFrame
    duplicate_findings: DataFrame


def dense_ordinals(df: DataFrame, keys: list[str], name: str = "__ordinal") -> DataFrame:
    """Numbers rows from 0 in the order of keys, and of the whole row's hash where keys tie. No task sorts more than its range of them.

    Rows are dealt by ranges of the keys, sorted and kept so; ranges are counted, and a row's number is its place within its range
    after those before.
    """
    ordered = df.repartitionByRange(*[quoted(k) for k in keys]).sortWithinPartitions(*[quoted(k) for k in keys], F.xxhash64(*[quoted(c) for c in df.columns]))
    held = settled(ordered.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in sorted(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each range
        offsets.append((r["part"], before))
        before += r["n"]
    ahead = local_rows(df.sparkSession, offsets, "__range long, __ahead long")
    return held.join(F.broadcast(ahead), part == F.col("__range")).withColumn(name, (place + F.col("__ahead")).cast("long")).drop("__range", "__place", "__ahead")


def key_bytes(c: Column, t: LogicalType) -> Column:
    """Length of a key value's canonical encoding: a tag, and for text and bytes a length."""
    if t.kind in ("utf8", "binary"):
        return F.when(c.isNull(), 1).otherwise(5 + F.octet_length(c)).cast("long")
    return F.when(c.isNull(), 1).otherwise(1 + WIDTHS.get(t.kind, 0)).cast("long")


def _linear(plan: Plan) -> list[str]:
    out, at = [], plan.root
    while True:
        out.append(at)
        node = plan.nodes[at]
        if isinstance(node, Scan):
            return out[::-1]
        if len(node.inputs) != 1:
            fail(Category.UNSUPPORTED, "a verification run takes a plan without joins and unions")
        at = node.inputs[0]


def _prefixed(schema: LogicalSchema) -> LogicalSchema:
    """The schema with names of working columns, which can't clash with the router's own."""
    return replace(schema, fields=tuple(replace(f, name=f"w_{f.name}") for f in schema.fields))


def verify(plan: Plan, sources: Sources, order_keys: list[str], provenance: Provenance | None = None) -> Verified:
    """Routes all rows that the plan's scan gives; order_keys are names of scanned columns that number the rows.

    Rows that tie in these are numbered by a hash of the row; rows alike in all columns are told apart by nothing, and may
    change places.
    """
    path = _linear(plan)
    if not isinstance(plan.nodes[plan.root], Materialize):
        fail(Category.INVALID_PLAN, "a plan ends in Materialize")
    provenance = provenance or Provenance(plan_fingerprint=plan.fingerprint(), canonical_plan_digest=plan.fingerprint())
    start = scan(plan.nodes[path[0]], sources)
    numbered = dense_ordinals(start.df, order_keys)
    source = F.struct(*[quoted(f.name) for f in start.schema.fields])
    df = numbered.select("__ordinal", source.alias("__source"), *[quoted(f.name).alias(f"w_{f.name}") for f in start.schema.fields])
    df = df.withColumns({"__alive": F.lit(True), "__ended": F.lit(None).cast(ENDED), "__findings": F.array().cast(FINDING), "__duplicates": F.array().cast(DUPLICATE), "__seen": F.array().cast("array<string>")})
    schema = start.schema
    validations: list[tuple[str, int, Validate]] = []
    dedups: list[tuple[str, int, Deduplicate]] = []
    for name in path[1:]:
        node = plan.nodes[name]
        rules = node.rules if isinstance(node, ApplyRules) else (FilterRows(node.predicate),) if isinstance(node, Filter) else ()
        if isinstance(node, Project):
            schema = replace(schema, fields=tuple(schema.by_id(i) for i in node.columns))
        for ordinal, rule in enumerate(rules):
            inner = _prefixed(schema)
            if isinstance(rule, Validate):
                df = _validated(df, predicate(rule.predicate, inner), name, ordinal, rule)
                validations.append((name, ordinal, rule))
            elif isinstance(rule, Deduplicate):
                if dedups:  # the frame is read twice; what went before is not run twice
                    df = settled(df, "routing")
                df = _deduplicated(df, schema, name, ordinal, rule)
                dedups.append((name, ordinal, rule))
            elif isinstance(rule, FilterRows):
                df = df.withColumn("__alive", F.col("__alive") & F.coalesce(F.when(F.col("__alive"), predicate(rule.predicate, inner)), F.lit(False)))
            elif isinstance(rule, Rename):
                old = schema.by_id(rule.column).name
                schema = schema_after(schema, rule)
                df = df.withColumnRenamed(f"w_{old}", f"w_{rule.to}")
            elif isinstance(rule, DropColumn):
                df = df.drop(f"w_{schema.by_id(rule.column).name}")
                schema = schema_after(schema, rule)
            else:
                after = schema_after(schema, rule)
                own, value = value_after(inner, rule)
                own = own.removeprefix("w_") if own.startswith("w_") and own.removeprefix("w_") in [f.name for f in schema.fields] else own
                df = df.withColumn(f"w_{own}", F.when(F.col("__alive"), value))
                schema = after
    df = df.withColumn("__findings", F.when(F.size("__findings") <= MAX_FINDINGS, F.col("__findings")).otherwise(raised(Category.LIMIT_EXCEEDED, "a row has too many findings").cast(FINDING)))
    routed = settled(df, "routed")
    said = provenance.columns()
    accepted = routed.where("__alive").select("__ordinal", *[quoted(f"w_{f.name}").alias(f.name) for f in schema.fields])
    findings = routed.select("__ordinal", F.explode("__findings").alias("f")).select(*said, F.col("__ordinal").alias("source_row_ordinal"), "f.node_id", "f.rule_ordinal", "f.severity", "f.predicate_outcome")
    duplicates = routed.select("__ordinal", F.explode("__duplicates").alias("d")).select(
        *said, F.col("__ordinal").alias("source_row_ordinal"), "d.first_source_row_ordinal", "d.node_id", "d.rule_ordinal", "d.key_column_count", "d.encoded_key_byte_count"
    )
    rejected = None
    if dedups or any(r.severity == "error" for *_, r in validations):
        rejected = routed.where("__ended IS NOT NULL").select(
            *[F.col("__source").getField(f.name).alias(f.name) for f in start.schema.fields],
            *said[:3],
            F.col("__ordinal").alias("source_row_ordinal"),
            F.col("__ended.rejection_kind").alias("rejection_kind"),
            *said[3:],
            F.col("__ended.node_id").alias("node_id"),
            F.col("__ended.rule_ordinal").alias("rule_ordinal"),
        )
    return Verified(accepted, schema, _validation_summary(routed, validations, said), findings, rejected, _dedup_summary(routed, dedups, said), duplicates)


def _seen(name: str, ordinal: int) -> Column:
    return F.lit(f"{ordinal}@{name}")


def _validated(df: DataFrame, p: Column, name: str, ordinal: int, rule: Validate) -> DataFrame:
    p = F.when(F.col("__alive"), p)  # a rule that would fail the run isn't evaluated for a row that is out
    failed = F.col("__alive") & ~F.coalesce(p, F.lit(False))
    outcome = F.when(p.isNull(), "null").otherwise("false")
    finding = F.array(F.struct(F.lit(name).alias("node_id"), F.lit(ordinal).alias("rule_ordinal"), F.lit(rule.severity).alias("severity"), outcome.alias("predicate_outcome"))).cast(FINDING)
    columns = {
        "__seen": F.when(F.col("__alive"), F.concat("__seen", F.array(_seen(name, ordinal)))).otherwise(F.col("__seen")),
        "__findings": F.when(failed, F.concat("__findings", finding)).otherwise(F.col("__findings")),
    }
    if rule.severity == "error":
        columns["__ended"] = F.when(failed, F.struct(F.lit("validation_error").alias("rejection_kind"), F.lit(name).alias("node_id"), F.lit(ordinal).alias("rule_ordinal")).cast(ENDED)).otherwise(F.col("__ended"))
        columns["__alive"] = F.col("__alive") & ~failed
    return df.withColumns(columns)


def _deduplicated(df: DataFrame, schema: LogicalSchema, name: str, ordinal: int, rule: Deduplicate) -> DataFrame:
    fields = [schema.by_id(k) for k in rule.keys]
    if any(not f.type.executable for f in fields):
        fail(Category.TYPE_ERROR, "a column can't be a deduplication key")
    columns = [quoted(f"w_{f.name}") for f in fields]
    keys = [F.coalesce(c, F.lit(None).cast("string")) if f.type.kind == "null" else c for c, f in zip(columns, fields, strict=True)]
    size = reduce(Column.__add__, [key_bytes(c, f.type) for c, f in zip(keys, fields, strict=True)])
    first = df.where("__alive").groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("__ordinal").alias("__first"))
    met = reduce(lambda x, y: x & y, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]) & F.col("__alive")
    joined = df.join(first, met, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    again = F.col("__alive") & (F.col("__first") < F.col("__ordinal"))
    checked = F.when(size <= MAX_KEY_BYTES, size).otherwise(raised(Category.LIMIT_EXCEEDED, "a deduplication key is too long").cast("long"))
    entry = F.array(
        F.struct(F.lit(name).alias("node_id"), F.lit(ordinal).alias("rule_ordinal"), F.col("__first").alias("first_source_row_ordinal"), F.lit(len(keys)).alias("key_column_count"), checked.alias("encoded_key_byte_count"))
    ).cast(DUPLICATE)
    ended = F.struct(F.lit("duplicate").alias("rejection_kind"), F.lit(name).alias("node_id"), F.lit(ordinal).alias("rule_ordinal")).cast(ENDED)
    return joined.withColumns(
        {
            "__seen": F.when(F.col("__alive"), F.concat("__seen", F.array(_seen(name, ordinal)))).otherwise(F.col("__seen")),
            "__duplicates": F.when(again, F.concat("__duplicates", entry)).otherwise(F.col("__duplicates")),
            "__ended": F.when(again, ended).otherwise(F.col("__ended")),
            "__alive": F.col("__alive") & ~F.coalesce(again, F.lit(False)),
        }
    ).drop("__first")


def _validation_summary(routed: DataFrame, rules: list[tuple[str, int, Validate]], said: list[Column]) -> DataFrame:
    """One row for each validation, also for those that no row reached."""
    listed = local_rows(routed.sparkSession, [(n, o, r.message, f"{o}@{n}") for n, o, r in rules], "node_id string, rule_ordinal int, message string, key string")
    evaluated = routed.select(F.explode("__seen").alias("key")).groupBy("key").agg(F.count("*").alias("evaluated"))
    hit = lambda field, value: F.count_if(F.col(f"f.{field}") == value)
    failed = (
        routed.select(F.explode("__findings").alias("f"))
        .groupBy(F.col("f.node_id").alias("n"), F.col("f.rule_ordinal").alias("o"))
        .agg(F.count("*").alias("fails"), hit("severity", "warning").alias("warnings"), hit("severity", "error").alias("errors"), hit("predicate_outcome", "null").alias("nulls"), hit("predicate_outcome", "false").alias("falses"))
    )
    joined = listed.join(evaluated, "key", "left").join(failed, (F.col("n") == F.col("node_id")) & (F.col("o") == F.col("rule_ordinal")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        *said, "node_id", "rule_ordinal", "message", n("evaluated").alias("evaluated_count"), (n("evaluated") - n("fails")).alias("pass_count"), n("fails").alias("fail_count"),
        n("warnings").alias("warning_count"), n("errors").alias("error_count"), n("nulls").alias("null_count"), n("falses").alias("false_count"),
    )


def _dedup_summary(routed: DataFrame, rules: list[tuple[str, int, Deduplicate]], said: list[Column]) -> DataFrame:
    listed = local_rows(routed.sparkSession, [(n, o, len(r.keys), f"{o}@{n}") for n, o, r in rules], "node_id string, rule_ordinal int, key_column_count int, key string")
    evaluated = routed.select(F.explode("__seen").alias("key")).groupBy("key").agg(F.count("*").alias("evaluated"))
    again = routed.select(F.explode("__duplicates").alias("d")).groupBy(F.col("d.node_id").alias("n"), F.col("d.rule_ordinal").alias("o")).agg(F.count("*").alias("again"))
    joined = listed.join(evaluated, "key", "left").join(again, (F.col("n") == F.col("node_id")) & (F.col("o") == F.col("rule_ordinal")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(*said, "node_id", "rule_ordinal", "key_column_count", n("evaluated").alias("evaluated_count"), (n("evaluated") - n("again")).alias("unique_count"), n("again").alias("duplicate_count"))
