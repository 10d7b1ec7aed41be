"""Catalog queries of sources, sinks and streams: test tables written in a format and read back through the engine."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.functions.expressions import Binary, Col, lit
from cleargrain.operators.preview import preview_node
from cleargrain.operators.verify import verify
from cleargrain.plans.catalog import _CUSTOMERS as CUSTOMERS
from cleargrain.plans.catalog import b, customers, pipe, project, query, rules, sources
from cleargrain.plans.model import Deduplicate, Validate
from cleargrain.plans.types import schema_of
from cleargrain.sinks.store import Store, export
from cleargrain.sources import registry, tabular, workbook
from cleargrain.streaming.batches import batches
from cleargrain.workspace import shared_folder

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}/{name}"


def _local(spark: SparkSession, name: str) -> Path:
    """A path of the driver's own, for files that it alone writes and reads (workbooks, local folders)."""
    return Path(tempfile.mkdtemp(prefix="cleargrain-")) / name


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _through(kind: str, table: str):
    """A table exported in a format and read back with its inferred schema."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _new(spark, f"rows.{kind}")
        export(_table(spark, sf_dir, table), path, kind)
        return tabular.read(spark, path, kind="ndjson" if kind == "jsonl" else kind)[0]

    return run


query("source_csv", _CUSTOMER)(_through("csv", "customer"))
query("source_tsv", _CUSTOMER)(_through("tsv", "customer"))
query("source_ndjson", _CUSTOMER)(_through("jsonl", "customer"))
query("source_parquet", "SELECT * FROM customer")(_through("parquet", "customer"))


@query("source_json", _NATION)
def _json(spark, sf_dir):
    """One array of objects; the format has no lines, so only a small table is written so."""
    path = _new(spark, "rows.json")
    _table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return tabular.read(spark, path, kind="json")[0]


@query("source_projection", "SELECT c_mktsegment, c_custkey FROM customer")
def _projection(spark, sf_dir):
    path = _new(spark, "rows.csv")
    export(_table(spark, sf_dir, "customer"), path, "csv")
    return tabular.read(spark, path, ["c_mktsegment", "c_custkey"], kind="csv")[0]


@query("source_override", "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _override(spark, sf_dir):
    """A Parquet file's types widened by a given schema."""
    from dataclasses import replace

    from cleargrain.plans.types import FLOAT64, INT64

    path = f"{sf_dir}/customer.parquet"
    found = tabular.inspect(spark, path).schema
    wider = {"c_custkey": FLOAT64, "c_nationkey": INT64}
    given = replace(found, fields=tuple(replace(f, type=wider.get(f.name, f.type)) for f in found.fields))
    return tabular.read(spark, path, schema=given)[0]


@query("source_inspect", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' ELSE 'utf8' END AS type FROM (DESCRIBE SELECT * FROM customer)")
def _inspect(spark, sf_dir):
    path = _new(spark, "rows.csv")
    export(_table(spark, sf_dir, "customer"), path, "csv")
    found = tabular.inspect(spark, path, kind="csv").schema
    return spark.createDataFrame([(f.name, f.type.kind) for f in found.fields], "name string, type string")


@query("source_customers", f"SELECT customer_id, name, email, amount, category, NULLIF(status, '') AS status, margin_pct FROM ({CUSTOMERS})")
def _customers(spark, sf_dir):
    """The pipeline's customers as a CSV file, read by their inferred schema; blanks and white space stay."""
    path = _new(spark, "customers.csv")
    export(customers(spark, sf_dir), path, "csv")
    return tabular.read(spark, path, ["customer_id", "name", "email", "amount", "category", "status", "margin_pct"])[0]


def _workbook(rows: list[tuple], names: list[str], path: Path) -> None:
    cell = lambda v: f'<c r="{{}}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{{}}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    lines = "".join(f'<row r="{i}">' + "".join(cell(v).format(f"{chr(65 + j)}{i}") for j, v in enumerate(row)) + "</row>" for i, row in enumerate([tuple(names), *rows], 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Nations" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{lines}</sheetData></worksheet>")


@query("source_workbook", _NATION)
def _book(spark, sf_dir):
    """The region and header that score best are read."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _local(spark, "nations.xlsx")
    _workbook([tuple(r) for r in df.collect()], df.columns, path)
    asset = registry.discover(registry.Connection("workbook", str(path.parent)))[0]
    region = workbook.regions(workbook.sheets(asset.path)[0])[0]
    header = max(region.headers, key=lambda h: (h.score, -h.row))
    return workbook.read(spark, asset.path, asset.sheet, workbook.Selection(region.box, header.row))[0]


def _store(spark: SparkSession) -> Store:
    return Store(spark, _new(spark, "store"))


@query("sink_snapshot", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _snapshot(spark, sf_dir):
    """Published, checked against its digests, and read from its manifest's files."""
    store = _store(spark)
    df = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    store.publish("positive", df, schema_of(df.schema), ["s_suppkey"])
    return store.read("positive", verified=True)


@query("sink_bundle", "SELECT 'accepted' AS section, count(DISTINCT event_type) FILTER (event_type <> 'view') AS n FROM events UNION ALL SELECT 'rejected', count(*) - count(DISTINCT event_type) FILTER (event_type <> 'view') FROM events UNION ALL SELECT 'validation_findings', count(*) FILTER (event_type = 'view') FROM events UNION ALL SELECT 'duplicate_findings', count(*) FILTER (event_type <> 'view') - count(DISTINCT event_type) FILTER (event_type <> 'view') FROM events")
def _bundle(spark, sf_dir):
    """Rows of four sections of a published bundle."""
    store = _store(spark)
    plan = pipe("events", "event_id event_type", rules(Validate(Binary("not_equal", Col("event_type"), lit("view")), "error", "views are not wanted"), Deduplicate(("event_type",))))
    store.publish_bundle("checked", verify(plan, sources(spark, sf_dir), ["event_id"]))
    parts = [store.read_section("checked", s, True).agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), "n") for s in ("accepted", "rejected", "validation_findings", "duplicate_findings")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("stream_batches", "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS sequence, s_suppkey FROM supplier")
def _batches(spark, sf_dir):
    """A finite stream of batches of seven rows."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey")
    found = [(e.sequence, v) for e in batches(df, schema_of(df.schema), rows=7) for v in e.batch.column(0).to_pylist()]
    return spark.createDataFrame(found, "sequence long, s_suppkey long")


@query("preview_flags", "SELECT 5 AS shown, count(*) > 5 AS rows_truncated, false AS bytes_truncated, false AS scan_truncated, true AS source_exhausted FROM nation WHERE n_regionkey >= 1")
def _flags(spark, sf_dir):
    plan = pipe("nation", "n_nationkey n_regionkey", project("n_nationkey"), where=b("greater_than_or_equal", "@n_regionkey", 1))
    p = preview_node(plan, sources(spark, sf_dir), "n1", rows=5)
    row = (p.table.num_rows, p.rows_truncated, p.bytes_truncated, p.scan_truncated, p.source_exhausted)
    return spark.createDataFrame([row], "shown int, rows_truncated boolean, bytes_truncated boolean, scan_truncated boolean, source_exhausted boolean")
