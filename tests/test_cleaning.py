"""The customer pipeline's stages and metrics, and every catalog query against its SQL."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from cleargrain.errors import CleaningError
from cleargrain.operators.cleaning import Stage, apply_stage, deduplicate, metrics, normalize, rows_text, run_pipeline
from cleargrain.plans import catalog

DDL = "customer_id string, name string, email string, amount double, category string, status string, created_at date, margin_pct double"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customers(spark):
    d = dt.date
    return spark.createDataFrame(
        [
            ("C1", " Ann ", "A@x.org ", 1.0, "a", "done", d(2024, 1, 2), 0.1),
            ("C2", "Ann", "a@x.org", 2.0, "b", "", d(2024, 1, 1), 0.2),
            ("C1", "Bob", None, None, "a", None, None, None),
            (None, "", "n@x.org", 3.0, "a", "open", d(2024, 1, 3), 0.3),
        ],
        DDL,
    )


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages(customers):
    assert ids(apply_stage(customers, Stage("f", "filter")), "status") == [("done",), ("open",)]
    assert ids(deduplicate(customers, "customer_id"), "customer_id", "name") == [("C1", " Ann "), ("C2", "Ann"), (None, "")]
    assert ids(deduplicate(customers, "customer_id", "Keep last"), "customer_id", "amount") == [("C1", 1.0), ("C2", 2.0), (None, 3.0)]
    assert len(ids(deduplicate(customers, "customer_id", nulls="Remove null rows"), "name")) == 2
    merged = deduplicate(customers, "category", "Merge records").where("category = 'a'").first()
    assert merged["name"] == " |  Ann  | Bob" and merged["amount"] == 3.0 and merged["created_at"] == dt.date(2024, 1, 2)
    assert ids(normalize(customers), "name", "email") == [("", "n@x.org"), ("Ann", "a@x.org"), ("Ann", "a@x.org"), ("Bob", None)]
    assert ("Unknown",) in ids(normalize(customers, "Remove null rows"), "name")
    with pytest.raises(CleaningError):
        apply_stage(customers, Stage("x", "sparkles"))


def test_metrics(customers):
    m = metrics(customers, customers.where("customer_id IS NOT NULL")).first()
    assert (m["rows_in"], m["rows_out"], m["null_cells"], m["missing_pct"], m["duplicates_pct"], m["quality_score"], m["quality_label"]) == (4, 3, 4, 33.3, 25.0, 67, "Fair")
    empty = metrics(customers.limit(0), customers.limit(0)).first()
    assert (empty["rows_in"], empty["rows_out"], empty["quality_score"], empty["duplicates_pct"]) == (0, 0, 100, 0.0)


def test_run_until(customers):
    stages = [Stage("a", "source"), Stage("b", "deduplicate", {"column": "customer_id"}), Stage("c", "export")]
    assert [s.id for s, *_ in run_pipeline(customers, stages, "b")] == ["a", "b"]
    with pytest.raises(CleaningError):
        run_pipeline(customers, stages, "z")
    assert [rows_text(n) for n in (5, 1500, 2_400_000)] == ["5", "1.5K", "2.4M"]


def _rows(df, columns):
    shown = lambda v: "~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(shown, r)) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalog_matches_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))
