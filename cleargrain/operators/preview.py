"""Bounded previews of a source or of any node of a plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from cleargrain.errors import Category, fail, sanitised
from cleargrain.operators.compile import Sources, compile_plan
from cleargrain.plans.model import Materialize, Plan
from cleargrain.plans.types import LogicalSchema

#: Fixed limits: rows and bytes by default and at most, of a source's preview and of a node's; rows that a node's scans.
SOURCE_ROWS, MAX_ROWS, MAX_BYTES = 1000, 10_000, 50 << 20
NODE_ROWS, NODE_BYTES, SCAN_ROWS = 1000, 8 << 20, 100_000


@dataclass(frozen=True)
class Preview:
    schema: LogicalSchema
    table: pa.Table
    rows_truncated: bool
    bytes_truncated: bool
    scan_truncated: bool = False
    source_exhausted: bool = True

    @property
    def truncated(self) -> bool:
        return self.rows_truncated or self.bytes_truncated or self.scan_truncated


def _prefix(table: pa.Table, most: int) -> int:
    """The largest number of first rows whose buffers take at most `most` bytes, by bisection."""
    low, high = 0, table.num_rows
    while low < high:
        middle = (low + high + 1) // 2
        if table.slice(0, middle).nbytes <= most:
            low = middle
        else:
            high = middle - 1
    return low


def preview(df: DataFrame, schema: LogicalSchema, rows: int = SOURCE_ROWS, most_bytes: int = MAX_BYTES) -> Preview:
    """The first rows; one more is read to tell whether there are more."""
    if not 0 < rows <= MAX_ROWS or not 0 < most_bytes <= MAX_BYTES:
        fail(Category.LIMIT_EXCEEDED, "a preview is too large or empty")
    with sanitised():
        table = df.limit(rows + 1).toArrow()
    more = table.num_rows > rows
    table = table.slice(0, rows)
    fits = _prefix(table, most_bytes)
    if table.num_rows and not fits:
        fail(Category.LIMIT_EXCEEDED, "the first row is larger than the preview")
    return Preview(schema, table.slice(0, fits), more, fits < table.num_rows)


def preview_node(plan: Plan, sources: Sources, target: str, rows: int = NODE_ROWS, most_bytes: int = NODE_BYTES, scan_rows: int = SCAN_ROWS) -> Preview:
    """The first rows of a node, made of at most `scan_rows` rows of each source; nodes after it are not compiled."""
    if isinstance(plan.nodes.get(target), Materialize):
        fail(Category.INVALID_REQUEST, "an output has no preview")
    if not 0 < scan_rows <= SCAN_ROWS:
        fail(Category.LIMIT_EXCEEDED, "a preview scans too many rows")
    capped: list[bool] = []

    def some(asset: str):
        df, schema = sources(asset)
        with sanitised():
            capped.append(df.limit(scan_rows + 1).count() > scan_rows)
        return (df.limit(scan_rows) if capped[-1] else df), schema

    r = compile_plan(plan, some, target)
    return replace(preview(r.df, r.schema, rows, most_bytes), scan_truncated=any(capped), source_exhausted=not any(capped))
