"""Files, workbooks, batches and snapshots."""

import datetime as dt
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_plans import table

from cleargrain.errors import Category, CleaningError, sanitised
from cleargrain.plans.types import LogicalField, LogicalSchema, LogicalType, simple, timestamp
from cleargrain.sinks.store import Store, export
from cleargrain.sources import registry, tabular, workbook
from cleargrain.streaming.batches import Context, RunGate, batches, rebatched

FIELDS = [("id", "int64"), ("label", "utf8"), ("ignored", "utf8")]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def collected(pair):
    with sanitised():
        return [tuple(r) for r in pair[0].collect()]


def fails(category, work):
    with pytest.raises(CleaningError) as e:
        work()
    assert e.value.category is category, e.value


@pytest.fixture
def five(tmp_path):
    rows = [(1, "a", "x"), (2, "b", "y"), (3, "c,d", "z")]
    pq.write_table(pa.table({n: [r[i] for r in rows] for i, (n, _) in enumerate(FIELDS)}), tmp_path / "rows.parquet")
    objects = [dict(zip(("id", "label", "ignored"), r, strict=True)) for r in rows]
    return [
        write(tmp_path / "rows.csv", "﻿id,label,ignored\n1,a,x\n2,b,y\n3,\"c,d\",z\n"),
        write(tmp_path / "rows.tsv", "id\tlabel\tignored\n1\ta\tx\n2\tb\ty\n3\tc,d\tz\n"),
        write(tmp_path / "rows.json", json.dumps(objects)),
        write(tmp_path / "rows.ndjson", "\n".join(map(json.dumps, objects)) + "\n\n"),
        str(tmp_path / "rows.parquet"),
    ]


def test_five_formats_give_the_same_rows(spark, five):
    for path in five:
        df, schema = tabular.read(spark, path, ["label", "id"])
        assert sorted(tuple(r) for r in df.collect()) == [("a", 1), ("b", 2), ("c,d", 3)], path
        assert [f.type for f in schema.fields] == [simple("utf8"), simple("int64")]


def test_inference(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b,c,d,e,f\n1,true,1.5,2024-01-01,,18446744073709551615\n2,false,2,x,,1\n")
    found = tabular.inspect(spark, path).schema
    assert [f.type.kind for f in found.fields] == ["int64", "boolean", "float64", "utf8", "null", "float64"]
    assert [f.nullable for f in found.fields] == [False, False, False, False, True, False]
    assert all(f.nullable and f.type.kind == "null" for f in tabular.inspect(spark, write(tmp_path / "h.csv", "a,b\n")).schema.fields)
    assert [f.name for f in tabular.inspect(spark, write(tmp_path / "n.csv", "1,2\n"), tabular.Options(header=False)).schema.fields] == ["column_1", "column_2"]


@pytest.mark.parametrize("text", ["id,id\n1,2\n", "id, \n1,2\n", "id,x\n1\n", "id,x\n1,2,3\n", ""])
def test_bad_headers_and_ragged_rows(spark, tmp_path, text):
    fails(Category.INVALID_DATA, lambda: tabular.inspect(spark, write(tmp_path / "bad.csv", text)))


def test_bool_and_text_is_drift(spark, tmp_path):
    fails(Category.SCHEMA_DRIFT, lambda: tabular.inspect(spark, write(tmp_path / "b.csv", "a\ntrue\nx\n")))


def test_drift_after_the_sample_also_where_not_projected(spark, tmp_path):
    one = tabular.Options(sample_rows=1)
    for name, text in (("a.csv", "id,ignored\n1,2\n2,x\n"), ("a.tsv", "id\tignored\n1\t2\n2\tx\n"), ("a.ndjson", '{"id":1,"ignored":2}\n{"id":2,"ignored":"x"}\n'), ("b.csv", "id,ignored\n1,2\n2,\n"), ("b.ndjson", '{"id":1,"ignored":2}\n{"id":2}\n'), ("c.ndjson", '{"id":1}\n{"id":2,"new":1}\n'), ("d.ndjson", '{"id":1}\n{"id":2,"id":3}\n')):
        fails(Category.SCHEMA_DRIFT, lambda path=write(tmp_path / name, text): collected(tabular.read(spark, path, ["id"], options=one)))
    ragged = write(tmp_path / "r.csv", "id,x\n1,2\n2,3,4\n")
    with pytest.raises(CleaningError):
        collected(tabular.read(spark, ragged, ["id"], options=one))


def test_json_framing(spark, tmp_path):
    for text in ('{"a":1}', '[{"a":1},]', '[{"a":1}] x', "[1]", '[{"a":1,"a":2}]'):
        with pytest.raises(CleaningError):
            collected(tabular.read(spark, write(tmp_path / "f.json", text)))


def test_nested_json(spark, tmp_path):
    path = write(tmp_path / "nested.json", '[{"id":1,"items":[1,2],"meta":{"ok":true}},{"id":2,"items":[],"meta":{}}]')
    df, schema = tabular.read(spark, path)
    assert schema.named("items").type == LogicalType("list", item=simple("int64")) and schema.named("meta").type.fields[0].nullable
    assert [(r["id"], r["items"], r["meta"]["ok"]) for r in df.orderBy("id").collect()] == [(1, [1, 2], True), (2, [], None)]


def test_a_given_schema(spark, tmp_path):
    path = write(tmp_path / "t.csv", "day,at,n\n2024-02-01,2024-02-01T10:00:00.5,7\n2024-02-02,2024-02-02 11:00:00,\n")
    f = lambda n, t, null=False: LogicalField(n, n, t, null)
    schema = LogicalSchema((f("day", simple("date32")), f("at", timestamp()), f("n", simple("int8"), True)))
    assert collected(tabular.read(spark, path, schema=schema)) == [(dt.date(2024, 2, 1), dt.datetime(2024, 2, 1, 10, 0, 0, 500000), 7), (dt.date(2024, 2, 2), dt.datetime(2024, 2, 2, 11), None)]
    fails(Category.SCHEMA_DRIFT, lambda: collected(tabular.read(spark, path, schema=LogicalSchema((f("day", simple("date32")), f("at", simple("date32")), f("n", simple("int8"), True))))))
    pq.write_table(pa.table({"n": pa.array([1, 2], pa.int32())}), tmp_path / "n.parquet")
    fails(Category.SCHEMA_DRIFT, lambda: tabular.read(spark, str(tmp_path / "n.parquet"), schema=LogicalSchema((f("n", simple("int16"), True),))))
    assert collected(tabular.read(spark, str(tmp_path / "n.parquet"), schema=LogicalSchema((f("n", simple("int64"), True),)))) == [(1,), (2,)]


def test_cells_with_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb, "c"', "x"), (2, "\r\n", "y"), (3, "plain", "z\n")]
    text = "id,a,b\n" + "".join('%d,"%s","%s"\n' % (i, a.replace('"', '""'), b) for i, a, b in rows)
    (tmp_path / "lines.csv").write_bytes(text.encode())
    df, schema = tabular.read(spark, str(tmp_path / "lines.csv"))
    assert sorted(map(tuple, df.collect())) == rows and [f.type.kind for f in schema.fields] == ["int64", "utf8", "utf8"]
    assert tabular.inspect(spark, str(tmp_path / "lines.csv"), tabular.Options(sample_rows=2)).sampled_rows == 1
    plain = write(tmp_path / "plain.csv", 'id,a\n1,"x, y"\n')
    assert not tabular._spread(spark, plain, '"') and collected(tabular.read(spark, plain)) == [(1, "x, y")]


def test_drift_is_found_in_the_scan(spark, tmp_path):
    """One job reads the rows and checks them."""
    path = write(tmp_path / "t.ndjson", '{"id":1}\n{"id":"x"}\n')
    df, _ = tabular.read(spark, path, [], options=tabular.Options(sample_rows=1))
    fails(Category.SCHEMA_DRIFT, lambda: collected((df,)))
    with pytest.raises(CleaningError), sanitised():
        df.count()


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a\n\xff\xfe\n")
    fails(Category.INVALID_DATA, lambda: tabular.inspect(spark, str(tmp_path / "x.csv")))


def test_discovery_and_capabilities(spark, five, tmp_path):
    c = registry.Connection("local_tabular", str(tmp_path))
    assert [a.kind for a in registry.discover(c)] == ["csv", "json", "ndjson", "parquet", "tsv"]
    (tmp_path / "link.csv").symlink_to(five[0])
    assert len(registry.discover(c)) == 5
    fails(Category.LIMIT_EXCEEDED, lambda: registry.discover(c, most=2))
    fails(Category.UNSUPPORTED, lambda: registry.checkpoint(c))
    fails(Category.UNSUPPORTED, lambda: registry.capabilities(registry.Connection("sql_database", "x")))
    fails(Category.INVALID_REQUEST, lambda: registry.Connection("local_tabular", "x", {"password": "y"}))
    assert registry.preview_asset(spark, c, registry.Asset(five[0], "csv"), 2).rows_truncated
    registry.test_connection(spark, c)
    fails(Category.NOT_FOUND, lambda: registry.test_connection(spark, registry.Connection("local_tabular", str(tmp_path / "gone"))))
    for key in ("", "/a", "a/../b", "a//b", "x" * 2000):
        fails(Category.INVALID_REQUEST, lambda key=key: registry.object_key(key))


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c><c r="C1" t="inlineStr"><is><t> </t></is></c></row>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>1</v></c><c r="C2" s="1"><v>45292</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>z</t></is></c><c r="B3"><f>1+1</f><v>2.5</v></c><c r="C3" s="1"><v>45293.5</v></c></row>
<row r="6"><c r="E6"><v>1</v></c><c r="F6" t="b"><v>1</v></c></row>
</sheetData><mergeCells><mergeCell ref="E6:F6"/></mergeCells></worksheet>"""


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>y</t></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
    return str(path)


def test_workbook(spark, book, tmp_path):
    sheet = workbook.sheets(book)[0]
    found = workbook.regions(sheet)
    assert [(r.box.top, r.box.left, r.box.bottom, r.box.right, r.confidence) for r in found] == [(0, 0, 2, 2, "high"), (5, 4, 5, 5, "low")]
    assert found[0].headers[0].row == 0 and found[0].headers[0].score == 80 and found[0].headers[0].confidence == "high"
    assert {"multiple_regions", "ambiguous_region", "merged_cells", "formulas", "duplicate_headers", "blank_headers"} <= set(workbook.findings(sheet, found))
    df, schema = workbook.read(spark, book, "One", workbook.Selection(found[0].box, 0))
    assert [(f.name, f.type.kind) for f in schema.fields] == [("name", "utf8"), ("name_2", "float64"), ("column_3", "timestamp")]
    assert [tuple(r) for r in df.collect()] == [("y", 1.0, dt.datetime(2024, 1, 1)), ("z", 2.5, dt.datetime(2024, 1, 2, 12))]
    assert [tuple(r) for r in workbook.read(spark, book, "One", workbook.Selection(found[1].box, None))[0].collect()] == [(1, True)]
    fails(Category.NOT_FOUND, lambda: workbook.read(spark, book, "Two", workbook.Selection(found[0].box, 0)))
    for name, category in (("x.xls", Category.UNSUPPORTED), ("gone.xlsx", Category.NOT_FOUND)):
        fails(category, lambda name=name: workbook.sheets(str(tmp_path / name)))


def test_ods(tmp_path):
    cell = lambda v: f'<t:table-cell o:value-type="float" o:value="{v}"/>'
    body = f'<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell o:value-type="string"><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"/>{cell(2)}</t:table-row><t:table-row t:number-rows-repeated="2">{cell(1.5)}</t:table-row></t:table></d>'
    with zipfile.ZipFile(tmp_path / "b.ods", "w") as z:
        z.writestr("content.xml", body)
    assert workbook.sheets(str(tmp_path / "b.ods"))[0].cells == {(0, 0): "a", (0, 3): 2, (1, 0): 1.5, (2, 0): 1.5}


def test_batches(spark):
    df, schema = table(spark, "a long, s string", [(i, "x") for i in range(10)])
    got = list(batches(df.orderBy("a"), schema, rows=4))
    assert [(e.sequence, e.rows) for e in got] == [(0, 4), (1, 4), (2, 2)] and got[0].batch.column(0).to_pylist() == [0, 1, 2, 3]
    assert [b.num_rows for b in rebatched((e.batch for e in got), 3)] == [3, 3, 3, 1]
    context = Context()
    context.cancelled.set()
    fails(Category.CANCELLED, lambda: list(batches(df, schema, context=context)))
    gate = RunGate(1)
    with gate:
        fails(Category.BUSY, gate.__enter__)
    fails(Category.INVALID_REQUEST, lambda: Context(1e9))


def test_store(spark, tmp_path):
    now = [100.0]
    store = Store(spark, str(tmp_path / "store"), lambda: now[0])
    t = table(spark, "a long, s string", [(2, "y"), (1, "x")])
    m = store.publish("first", *t, order=["a"], quality=90)
    assert m.rows == 2 and sorted(tuple(r) for r in store.read("first", verified=True).collect()) == [(1, "x"), (2, "y")]
    assert store.manifest("first").files == m.files
    store.verify("first")
    fails(Category.INVALID_REQUEST, lambda: store.publish("first", *t))
    fails(Category.INVALID_REQUEST, lambda: store.publish("../x", *t))
    (tmp_path / "store/staging/snapshot-left").mkdir()
    (tmp_path / "store/snapshots/unnamed").mkdir()
    assert store.recover() == ["snapshots/unnamed", "staging/snapshot-left"]
    part = tmp_path / "store/snapshots/first/data" / m.files[0][0]
    part.write_bytes(part.read_bytes() + b"x")
    fails(Category.STORAGE, lambda: store.verify("first"))
    store.tombstone("first")
    fails(Category.NOT_FOUND, lambda: store.read("first"))
    assert store.collect(10) == []
    now[0] += 11
    assert store.collect(10) == ["snapshot/first"] and not part.exists()


def test_bundle(spark, tmp_path):
    from test_plans import linear, rules

    from cleargrain.functions.expressions import Binary, Col, lit
    from cleargrain.operators.verify import verify
    from cleargrain.plans.model import Deduplicate, Validate

    t = table(spark, "value long", [(0,), (1,), (2,)])
    check = Validate(Binary("greater_than", Col("value"), lit(0)), "error", "low")
    store = Store(spark, str(tmp_path / "s"))
    made = store.publish_bundle("b", verify(linear("value", rules(check, Deduplicate(("value",)))), lambda _: t, ["value"]))
    assert made["accepted"].rows == 2 and made["rejected"].rows == 1 and store.read_section("b", "validation_findings", True).count() == 1
    assert "rejected" not in store.publish_bundle("c", verify(linear("value", rules(Deduplicate(("value",)))), lambda _: t, ["value"]))
    fails(Category.NOT_FOUND, lambda: store.read_section("c", "rejected"))


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet"])
def test_export(spark, tmp_path, kind):
    df, _ = table(spark, "a long, s string", [(1, 'x,"y"'), (2, None)], {"s"})
    export(df.coalesce(1), str(tmp_path / kind), kind)
    with pytest.raises(CleaningError):
        export(df, str(tmp_path / kind), kind)
