"""The customer-cleaning pipeline: source, filter, deduplicate, normalize and export stages, and their metrics.

Stages are a chain of DataFrames; nothing is written between them. Metrics of a stage are one aggregation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.errors import Category, fail
from cleargrain.functions.expressions import quoted

#: Columns that every stage but a merge has, in order.
COLUMNS = ("customer_id", "name", "email", "amount", "category", "status", "created_at", "margin_pct")
KINDS = ("source", "filter", "deduplicate", "normalize", "export")
STRATEGIES = ("Keep first", "Keep last", "Merge records")
NULLS = ("Ignore", "Treat as duplicate", "Remove null rows")


@dataclass(frozen=True)
class Stage:
    id: str
    kind: str
    config: dict[str, str] = field(default_factory=dict)


def _present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def view_name(stage: Stage) -> str:
    """The view that an export stage makes of its rows: its configured name, or one made of its id."""
    return re.sub(r"\W", "_", stage.config.get("name") or f"stage_{stage.id}")


def apply_stage(df: DataFrame, stage: Stage) -> DataFrame:
    config = stage.config
    match stage.kind:
        case "source":
            return df
        case "export":
            df.createOrReplaceTempView(view_name(stage))
            return df.sparkSession.table(view_name(stage))
        case "filter":
            return df.where(_present(quoted(config.get("column", "status"))))
        case "deduplicate":
            return deduplicate(df, config.get("column", "customer_id"), config.get("strategy", "Keep first"), config.get("nullHandling", "Ignore"))
        case "normalize":
            return normalize(df, config.get("nullHandling", "Ignore"))
    return fail(Category.INVALID_PLAN, "no such stage")


def deduplicate(df: DataFrame, column: str, strategy: str = "Keep first", nulls: str = "Ignore") -> DataFrame:
    """One row for each value of the column; null is a value. Rows alike in created_at tie by the other columns, smallest first.

    First and last rows are picked by an aggregate, which sums up before it shuffles; there is no window over a hot value.
    """
    if strategy not in STRATEGIES or nulls not in NULLS:
        fail(Category.INVALID_PLAN, "no such deduplication")
    key = quoted(column)
    if nulls == "Remove null rows":
        df = df.where(_present(key))
    if strategy == "Merge records":
        joined = lambda c: F.concat_ws(" | ", F.sort_array(F.collect_set(c)))
        text = lambda c: F.when(F.count(c) > 0, joined(c)).alias(c)
        merged = df.groupBy(key.alias(column)).agg(
            *[text(c) for c in ("name", "email") if c != column],
            *[F.max(c).alias(c) for c in ("amount", "category", "status", "margin_pct") if c != column],
            *[F.min(c).alias(c) for c in ("created_at",) if c != column],
        )
        rest = ("name", "email", "amount", "category", "status", "created_at", "margin_pct")
        return merged.select(quoted(column), *[quoted(c) for c in rest if c != column])
    tie = [quoted(c) for c in COLUMNS if c != "created_at"]
    rank = F.struct(F.col("created_at").isNull().alias("late"), F.col("created_at"), *tie)
    if strategy == "Keep last":  # the latest date first (a null date counts as the earliest), then the smallest of the rest
        top = df.groupBy(key.alias("__key")).agg(F.max("created_at").alias("__top"))
        df = df.join(top, key.eqNullSafe(F.col("__key")) & F.col("created_at").eqNullSafe(F.col("__top"))).drop("__key", "__top")
    return df.groupBy(key.alias("__key")).agg(F.min(rank).alias("r")).select(*[F.col("r").getField(c).alias(c) for c in COLUMNS])


def normalize(df: DataFrame, nulls: str = "Ignore") -> DataFrame:
    name, email = F.col("name"), F.col("email")
    named = F.when(_blank(name), F.lit("Unknown") if nulls == "Remove null rows" else name).otherwise(F.trim(name))
    mailed = F.when(_blank(email), email).otherwise(F.lower(F.trim(email)))
    return df.select("customer_id", named.alias("name"), mailed.alias("email"), "amount", "category", "status", "created_at", "margin_pct")


def _half_up(c: Column) -> Column:
    """To the next whole number; halves go up."""
    return F.floor(c + 0.5)


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_in, rows_out, missing_pct, null_cells, quality_score, quality_label, duplicates_pct: one row."""
    counted = before.agg(F.count("*").alias("rows_in"))
    cells = [_blank(F.col("name")), F.col("email").isNull(), F.col("amount").isNull(), _blank(F.col("status"))]
    any_null = F.col("name").isNull() | F.col("email").isNull() | F.col("amount").isNull() | F.col("status").isNull()
    out = after.agg(F.count("*").alias("rows_out"), F.count_if(any_null).alias("with_null"), sum((F.count_if(c) for c in cells[1:]), F.count_if(cells[0])).alias("null_cells"))
    rows = F.greatest(F.col("rows_out"), F.lit(1))
    score = F.greatest(F.lit(0), F.least(F.lit(100), _half_up(100 - F.col("null_cells") / (rows * 4) * 100)))
    joined = counted.crossJoin(out)  # one row each
    return joined.select(
        "rows_in",
        "rows_out",
        (_half_up(F.col("with_null") / rows * 1000) / 10).alias("missing_pct"),
        "null_cells",
        score.cast("long").alias("quality_score"),
        F.when(score >= 80, "Good").when(score >= 60, "Fair").otherwise("Poor").alias("quality_label"),
        F.when(F.col("rows_in") > 0, _half_up((F.col("rows_in") - F.col("rows_out")) / F.greatest(F.col("rows_in"), F.lit(1)) * 1000) / 10).otherwise(0.0).alias("duplicates_pct"),
    )


def run_pipeline(source: DataFrame, stages: list[Stage], until: str | None = None) -> list[tuple[Stage, DataFrame, DataFrame]]:
    """(stage, its rows, its metrics) in order, up to and with the stage named."""
    out, df = [], source
    for stage in stages:
        after = apply_stage(df, stage)
        out.append((stage, after, metrics(df, after)))
        df = after
        if stage.id == until:
            break
    else:
        if until is not None:
            fail(Category.NOT_FOUND, "no such stage")
    return out


def rows_text(n: int) -> str:
    return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}K" if n >= 1_000 else str(n)
