"""Catalog queries of what is refused, inferred, bounded and recorded: each row is a case and what came of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.errors import CleaningError, sanitised
from cleargrain.events import Session
from cleargrain.functions.expressions import Binary, Cast, Coalesce, Col, Unary, lit, nullable, referenced, type_of
from cleargrain.operators.engine import Engine
from cleargrain.operators.preview import preview
from cleargrain.operators.verify import verify
from cleargrain.plans.catalog import b, pipe, query, rules, sources, where
from cleargrain.plans.catalog_io import _local, _new, _store, _table, _workbook
from cleargrain.plans.model import CastColumn, Deduplicate, Plan, Rename, Validate
from cleargrain.plans.types import INT64, UTF8, LogicalField, LogicalSchema, LogicalType, schema_of, simple, timestamp
from cleargrain.sinks.store import export
from cleargrain.sources import registry, tabular, workbook
from cleargrain.streaming.batches import Context, RunGate
from cleargrain.workspace import local_rows


def outcome(work: Callable[[], object]) -> str:
    """The category of the error that the work ends in, or `ok`."""
    try:
        with sanitised():
            work()
    except CleaningError as error:
        return error.category.value[0]
    return "ok"


def cases(spark: SparkSession, found: dict[str, Callable[[], object]]) -> DataFrame:
    return local_rows(spark, [(name, outcome(work)) for name, work in found.items()], "name string, outcome string")


def listed(expected: dict[str, str], names: str = "name, outcome") -> str:
    """SQL of a table of two text columns."""
    return f"SELECT * FROM (VALUES {', '.join(f'''('{a}', '{b}')''' for a, b in expected.items())}) AS t({names})"


def lines(spark: SparkSession, name: str, text: str) -> str:
    """A small text asset in the shared folder."""
    path = _new(spark, name)
    local_rows(spark, [(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


ONE = tabular.Options(sample_rows=1)

_DRIFT = {
    "text for a number": "schema_drift", "text for a number, not projected": "schema_drift", "empty cell, not null": "schema_drift", "empty cell, null": "ok", "ragged row": "invalid_data", "short row": "invalid_data",
    "repeated header": "invalid_data", "blank header": "invalid_data", "no rows": "ok", "boolean and text": "schema_drift", "json text for a number": "schema_drift", "json unknown field": "schema_drift",
    "json repeated key": "invalid_data", "json missing field": "schema_drift", "json field missing in the sample": "ok", "json array": "invalid_data", "bad date": "schema_drift", "good dates": "ok", "byte order mark": "ok", "cells with line breaks": "ok",
}


@query("source_drift", listed(_DRIFT))
def _drift(spark, sf_dir):
    """Every value of every column must fit the settled schema, also where it isn't projected."""

    def reads(name: str, text: str, columns: list[str] | None = None, options: tabular.Options | None = None, schema: LogicalSchema | None = None) -> Callable[[], object]:
        return lambda: tabular.read(spark, lines(spark, name, text), columns, schema, options)[0].collect()

    field = lambda n, t, null=False: LogicalField(n, n, t, null)
    dates = LogicalSchema((field("day", simple("date32")), field("at", timestamp(), True)))
    works = (
        reads("a.csv", "id,x\n1,2\n2,y\n", options=ONE), reads("a.tsv", "id\tx\n1\t2\n2\ty\n", ["id"], ONE), reads("b.csv", "id,x\n1,2\n2,\n", ["id"], ONE), reads("b.csv", "id,x\n1,\n2,\n", options=ONE),
        reads("c.csv", "id,x\n1,2\n2,3,4\n", ["id"], ONE), reads("c.csv", "id,x\n1,2\n2\n", ["id"], ONE), reads("d.csv", "id,id\n1,2\n"), reads("d.csv", "id, \n1,2\n"), reads("e.csv", "id,x\n"),
        reads("f.csv", "a\ntrue\nx\n"), reads("a.ndjson", '{"id":1,"x":2}\n{"id":2,"x":"y"}\n', ["id"], ONE), reads("b.ndjson", '{"id":1}\n{"id":2,"x":1}\n', options=ONE), reads("c.ndjson", '{"id":1}\n{"id":2,"id":3}\n'),
        reads("d.ndjson", '{"id":1,"x":2}\n{"id":2}\n', options=ONE), reads("d.ndjson", '{"id":1,"x":2}\n{"id":2}\n'), reads("e.ndjson", "[1]\n"), reads("g.csv", "day,at\n2024-02-30,\n", schema=dates),
        reads("g.csv", "day,at\n2024-02-29,2024-01-01T00:00:00.5\n2024-03-01,2024-01-01 00:00:00\n", schema=dates), reads("h.csv", "﻿id\n1\n"), reads("i.csv", 'id,x\n1,"a\nb"\n2,"c,""d"""\n'),
    )
    return cases(spark, dict(zip(_DRIFT, works, strict=True)))


_MERGE = [("n", "int64", False), ("f", "float64", False), ("u", "uint64", False), ("both", "float64", False), ("b", "boolean", False), ("s", "utf8", False), ("none", "null", True), ("some", "int64", True), ("day", "utf8", False)]


@query("source_merge", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str(x).lower()})" for n, t, x in _MERGE) + ") AS t(name, type, nullable)")
def _merge(spark, sf_dir):
    """Types and nulls inferred from a sample of CSV."""
    found = tabular.inspect(spark, lines(spark, "m.csv", "n,f,u,both,b,s,none,some,day\n1,1.5,18446744073709551615,1,true,x,,,2024-01-01\n-2,.5e3,9223372036854775808,2.5,false,7x,,3,2024-01-02\n")).schema
    return local_rows(spark, [(f.name, f.type.kind, f.nullable) for f in found.fields], "name string, type string, nullable boolean")


_JSON = [("id", "int64", False), ("items", "list<float64>", False), ("meta", "struct<a:int64?,b:utf8?>", False), ("late", "boolean", True), ("void", "null", True)]


@query("source_merge_json", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str(x).lower()})" for n, t, x in _JSON) + ") AS t(name, type, nullable)")
def _merge_json(spark, sf_dir):
    """Fields that a row lacks may be null, new ones come last, lists and structs merge."""

    def shown(t: LogicalType) -> str:
        if t.kind == "list":
            return f"list<{shown(t.item)}>"
        return f"struct<{','.join(f'{f.name}:{shown(f.type)}' + '?' * f.nullable for f in t.fields)}>" if t.kind == "struct" else t.kind

    text = '{"id":1,"items":[1,2],"meta":{"a":1},"void":null}\n{"id":2,"items":[2.5],"meta":{"b":"x"},"late":true,"void":null}\n'
    found = {f.name: f for f in tabular.inspect(spark, lines(spark, "m.ndjson", text)).schema.fields}
    return local_rows(spark, [(n, shown(found[n].type), found[n].nullable) for n, *_ in _JSON], "name string, type string, nullable boolean")


@query("source_sample", "SELECT 25::BIGINT AS sampled, true AS truncated, count(*) AS rows FROM customer")
def _sample(spark, sf_dir):
    """A schema from a bounded sample, all rows read by it."""
    path = _new(spark, "rows.csv")
    export(_table(spark, sf_dir, "customer").coalesce(1), path, "csv")
    options = tabular.Options(sample_rows=25)
    found = tabular.inspect(spark, path, options)
    return tabular.read(spark, path, [], found.schema, options)[0].agg(F.lit(found.sampled_rows).cast("long").alias("sampled"), F.lit("sample_truncated" in found.findings).alias("truncated"), F.count("*").alias("rows"))


_LINE = "'line ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '\"quoted\", ' || p_name WHEN p_partkey % 3 = 1 THEN ',' || chr(10) || chr(10) || '''' ELSE '' END"


@query("source_csv_line_breaks", f"SELECT p_partkey, {_LINE} AS note, p_size::BIGINT AS p_size FROM part")
def _breaks(spark, sf_dir):
    """Cells with line breaks, quotes and delimiters, written by `export` and read back."""
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, F.concat(F.lit('\n"quoted", '), "p_name")).when(key % 3 == 1, F.lit(",\n\n'")).otherwise("")
    df = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("line "), key.cast("string"), tail).alias("note"), "p_size")
    path = _new(spark, "rows.csv")
    export(df, path, "csv")
    return tabular.read(spark, path)[0]


_KEYS = {"a/b.csv": "ok", "": "invalid_request", "/a": "invalid_request", "a/../b": "invalid_request", "a//b": "invalid_request", "long": "invalid_request", "too many": "limit_exceeded", "too deep": "limit_exceeded", "gone": "not_found", "secret": "invalid_request", "sql": "unsupported", "resume": "unsupported"}


@query("source_discovery", listed(_KEYS))
def _discovery(spark, sf_dir):
    """Bounds of discovery and of object keys, capabilities, and connections that hold secrets."""
    root = _local(spark, "files")
    for name in ("a.csv", "b.ndjson", "deep/er/c.tsv", "skipped.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("id\n1\n")
    c = registry.Connection("local_tabular", str(root))
    key = lambda k: lambda: registry.object_key(k)
    works = (
        *(key(k) for k in ("a/b.csv", "", "/a", "a/../b", "a//b", "x" * 1025)), lambda: registry.discover(c, most=2), lambda: registry.discover(c, depth=2), lambda: registry.discover(registry.Connection("local_tabular", f"{root}/gone")),
        lambda: registry.Connection("local_tabular", "x", {"connection_string": "y"}), lambda: registry.capabilities(registry.Connection("sql_database", "x")), lambda: registry.checkpoint(c),
    )
    return cases(spark, dict(zip(_KEYS, works, strict=True)))


@query("source_discovered", "SELECT * FROM (VALUES ('a.csv', 'csv'), ('b.ndjson', 'ndjson'), ('deep/c.tsv', 'tsv'), ('table.parquet', 'parquet')) AS t(name, kind)")
def _discovered(spark, sf_dir):
    """Files of known formats, links not followed, and an object that is a folder of parts."""
    root = _local(spark, "files")
    for name in ("b.ndjson", "a.csv", "deep/c.tsv", "skipped.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("id\n1\n")
    (root / "link.csv").symlink_to(root / "a.csv")
    found = [(a.path.split("/files/")[1], a.kind) for a in registry.discover(registry.Connection("local_tabular", str(root)))]
    bucket = _new(spark, "bucket")
    export(_table(spark, sf_dir, "region"), f"{bucket}/table.parquet", "parquet")
    found += [(a.path.split("/bucket/")[1], a.kind) for a in registry.discover(registry.Connection("object_store", bucket))]
    return local_rows(spark, found, "name string, kind string")


@query("source_object_store", "SELECT section, n FROM (SELECT 'rows' AS section, count(*) AS n FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'uploaded', count(*) FROM nation UNION ALL SELECT 'changed', 1)")
def _objects(spark, sf_dir):
    """A Parquet object read as the version that was listed, text uploaded and read, and a version that is gone."""
    root = _new(spark, "bucket")
    c = registry.Connection("object_store", root)
    export(_table(spark, sf_dir, "orders").coalesce(2), f"{root}/orders.parquet", "parquet")
    asset = registry.discover(c)[0]
    n = registry.read_asset(spark, c, asset)[0].where("o_totalprice > 1000").count()
    registry.upload(spark, c, "in/nation.csv", _table(spark, sf_dir, "nation"), "csv")
    uploaded = registry.read_asset(spark, c, next(a for a in registry.discover(c) if a.kind == "csv"))[0].count()
    _table(spark, sf_dir, "orders").limit(1).write.mode("append").parquet(f"{root}/orders.parquet")
    changed = outcome(lambda: registry.read_asset(spark, c, asset)) == "schema_drift"
    return local_rows(spark, [("rows", n), ("uploaded", uploaded), ("changed", int(changed))], "section string, n long")


_EXPRESSIONS = {"depth": "limit_exceeded", "nodes": "limit_exceeded", "secret": "invalid_plan", "text and number": "type_error", "a date literal": "ok"}


@query("expr_checks", listed({"references": "a, b", "nullable sum": "true", "nullable coalesce": "false", "nullable division": "false"} | _EXPRESSIONS))
def _expressions(spark, sf_dir):
    """References, nullability, bounds and literals of expressions, before anything is compiled."""
    schema = LogicalSchema((LogicalField("a", "a", INT64, True), LogicalField("b", "b", INT64, False), LogicalField("s", "s", UTF8, True)))
    total = Binary("add", Col("a"), Binary("multiply", Col("b"), Col("a")))
    rows = [("references", ", ".join(referenced(total)))]
    rows += [(n, str(nullable(e, schema)).lower()) for n, e in (("nullable sum", total), ("nullable coalesce", Coalesce((Col("a"), Col("b")))), ("nullable division", Binary("divide", Col("b"), lit(2))))]
    deep, wide = lit(True), [lit(True)] * 1024
    for _ in range(70):
        deep = Unary("not", deep)
    while len(wide) > 1:
        wide = [Binary("and", x, y) for x, y in zip(wide[::2], wide[1::2], strict=True)]
    run = lambda e: lambda: sources(spark, sf_dir) and pipe_rows(spark, sf_dir, e)
    works = (run(deep), run(wide[0]), run(b("equal", "@n_name", "password=hunter2")), run(b("equal", "@n_name", 1)), run(b("equal", Cast(lit("2024-01-01"), simple("date32")), Cast(lit("2024-01-01"), simple("date32")))))
    rows += [(n, outcome(w)) for n, w in zip(_EXPRESSIONS, works, strict=True)]
    assert type_of(total, schema) == INT64
    return local_rows(spark, rows, "name string, outcome string")


def pipe_rows(spark: SparkSession, sf_dir: str, e) -> list:
    from cleargrain.operators.compile import compile_plan

    return compile_plan(pipe("nation", "n_nationkey n_name", where(e)), sources(spark, sf_dir)).df.collect()


_VERIFY = {"a key of 64 KiB": "limit_exceeded", "a shorter key": "ok", "a list as key": "type_error"}


@query("verify_limits", listed(_VERIFY))
def _limits(spark, sf_dir):
    """Keys of a deduplication have bounds."""

    def run(value: str) -> Callable[[], object]:
        df = spark.range(2).selectExpr("id AS i", f"{value} AS v")
        schema = schema_of(df.schema, "t")
        schema = replace(schema, fields=tuple(replace(f, id=f.name) for f in schema.fields))
        return lambda: verify(pipe("t", "i v", rules(Deduplicate(("v",)))), lambda _: (df, schema), ["i"]).duplicate_findings.collect()

    return cases(spark, dict(zip(_VERIFY, map(run, ("repeat('x', 65536)", "repeat('x', 65531)", "array(id)")), strict=True)))


@query("verify_sections", "SELECT * FROM (VALUES ('accepted'), ('dedup_summary'), ('duplicate_findings'), ('validation_findings'), ('validation_summary')) AS t(section)")
def _sections(spark, sf_dir):
    """A run in which no row is rejected has no section of rejected rows."""
    store = _store(spark)
    made = store.publish_bundle("all", verify(pipe("nation", "n_nationkey n_name", rules(Validate(b("greater_than_or_equal", "@n_nationkey", 0), "error", "low"), Deduplicate(("n_nationkey",)))), sources(spark, sf_dir), ["n_nationkey"]))
    return local_rows(spark, [(s,) for s in made], "section string")


@query("verify_provenance", "SELECT DISTINCT 'source_asset' AS input_kind, 'events-1' AS input_id, 'v7' AS input_version_digest, 'plan' AS plan_fingerprint, 'canon' AS canonical_plan_digest, 'n1' AS node_id, count(*) OVER () AS n FROM events WHERE event_type = 'view'")
def _provenance(spark, sf_dir):
    """Every row of a report says what it was made from."""
    from cleargrain.operators.verify import Provenance

    plan = pipe("events", "event_id event_type", rules(Validate(b("not_equal", "@event_type", "view"), "error", "views are not wanted")))
    v = verify(plan, sources(spark, sf_dir), ["event_id"], Provenance("source_asset", "events-1", "v7", "plan", "canon"))
    columns = ["input_kind", "input_id", "input_version_digest", "plan_fingerprint", "canonical_plan_digest", "node_id"]
    return v.rejected.groupBy(*columns).agg(F.count("*").alias("n"))


_STORE = {"taken id": "invalid_request", "odd id": "invalid_request", "recovered": "snapshots/unnamed staging/snapshot-left", "changed file": "storage", "dead": "not_found", "kept": "", "collected": "snapshot/first"}


@query("store_lifecycle", listed(_STORE))
def _lifecycle(spark, sf_dir):
    """A snapshot published, damaged, made dead and collected; left-overs are recovered."""
    from cleargrain.sinks.store import Store

    now = [100.0]
    store = Store(spark, _new(spark, "store"), lambda: now[0])
    df = _table(spark, sf_dir, "region")
    m = store.publish("first", df, schema_of(df.schema))
    rows = [(n, outcome(lambda id=id: store.publish(id, df, schema_of(df.schema)))) for n, id in (("taken id", "first"), ("odd id", "../x"))]
    for left in ("staging/snapshot-left", "snapshots/unnamed"):
        df.write.parquet(f"{store.root}/{left}")
    rows.append(("recovered", " ".join(store.recover())))
    spark.range(3).coalesce(1).write.mode("overwrite").parquet(f"{store.root}/snapshots/first/data/{m.files[0][0]}")
    rows += [("changed file", outcome(lambda: store.verify("first"))), ("dead", outcome(lambda: store.tombstone("first") or store.read("first")))]
    rows.append(("kept", " ".join(store.collect(10))))
    now[0] += 11
    rows.append(("collected", " ".join(store.collect(10))))
    return local_rows(spark, rows, "name string, outcome string")


_BOOK = {"region": "0 0 3 2 high", "header": "0 high", "names": "key key_2 column_3", "types": "int64 utf8 int64", "findings": "blank_headers duplicate_headers", "xls": "unsupported", "gone": "not_found"}


@query("workbook_findings", listed(_BOOK))
def _findings(spark, sf_dir):
    """The region, header, names, types and findings of a sheet."""
    path = _local(spark, "book.xlsx")
    _workbook([(1, "a", 2), (2, "b", 3), (3, "c", 4)], ["key", "key", " "], path)
    sheet = workbook.sheets(str(path))[0]
    found = workbook.regions(sheet)
    r, h = found[0], max(found[0].headers, key=lambda x: (x.score, -x.row))
    _, schema = workbook.read(spark, str(path), sheet.name, workbook.Selection(r.box, h.row))
    rows = [
        ("region", f"{r.box.top} {r.box.left} {r.box.bottom} {r.box.right} {r.confidence}"), ("header", f"{h.row} {h.confidence}"), ("names", " ".join(f.name for f in schema.fields)), ("types", " ".join(f.type.kind for f in schema.fields)),
        ("findings", " ".join(sorted(workbook.findings(sheet, found)))), ("xls", outcome(lambda: workbook.sheets("x.xls"))), ("gone", outcome(lambda: workbook.sheets(str(path) + ".xlsx"))),
    ]
    return local_rows(spark, rows, "name string, outcome string")


@query("preview_connector", "SELECT least(count(*), 100) AS shown, count(*) > 100 AS rows_truncated, false AS bytes_truncated, 'limit_exceeded' AS too_many, 'limit_exceeded' AS row_too_large FROM customer")
def _connector(spark, sf_dir):
    """A source's preview within its bounds."""
    c = registry.Connection("local_tabular", sf_dir)
    asset = registry.Asset(f"{sf_dir}/customer.parquet", "parquet")
    p = registry.preview_asset(spark, c, asset, 100)
    df, schema = registry.read_asset(spark, c, asset)
    row = (p.table.num_rows, p.rows_truncated, p.bytes_truncated, outcome(lambda: registry.preview_asset(spark, c, asset, 10_001)), outcome(lambda: preview(df, schema, 5, 8)))
    return local_rows(spark, [row], "shown long, rows_truncated boolean, bytes_truncated boolean, too_many string, row_too_large string")


_RUNS = {
    "cycle": "invalid_plan", "arity": "invalid_plan", "no such input": "invalid_plan", "no output": "invalid_plan", "65 nodes": "limit_exceeded", "257 rules": "limit_exceeded", "fingerprint": "same", "busy": "busy",
    "deadline of an hour": "invalid_request", "cancelled": "cancelled", "late": "deadline_exceeded", "events": "snapshot_materialized", "failed run": "not_found", "odd plan text": "invalid_plan",
}


@query("run_laws", listed({k: v for k, v in _RUNS.items() if k in ("fingerprint", "busy", "deadline of an hour", "cancelled", "events", "failed run")}))
def _runs(spark, sf_dir):
    """Runs under a gate, a deadline and cancellation; a run that fails leaves nothing."""
    engine = Engine(spark, sources(spark, sf_dir), _store(spark), Session("s"), RunGate(1))
    plan = pipe("nation", "n_nationkey n_name", rules(Rename("n_name", "name")))
    rows = [("fingerprint", "same" if Plan.from_json(plan.canonical()).fingerprint() == plan.fingerprint() else "other")]
    with engine.gate:
        rows.append(("busy", outcome(lambda: engine.materialize(plan, "busy"))))
    stopped = Context()
    stopped.cancelled.set()
    rows += [("deadline of an hour", outcome(lambda: Context(3600.0))), ("cancelled", outcome(lambda: engine.materialize(plan, "stopped", context=stopped)))]
    engine.materialize(plan, "made")
    last = engine.session.events[-1]
    rows.append(("events", f"{last.kind}_{last.happened}"))
    outcome(lambda: engine.materialize(pipe("nation", "n_nationkey n_name", rules(CastColumn("n_name", INT64))), "bad"))
    rows.append(("failed run", outcome(lambda: engine.store.read("bad"))))
    return local_rows(spark, rows, "name string, outcome string")
