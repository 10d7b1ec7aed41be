"""Runs: a plan materialised to a snapshot, verified to a bundle, or previewed, under a gate, a deadline and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from cleargrain.errors import Category, CleaningError, fail, sanitised
from cleargrain.events import Session
from cleargrain.operators.compile import Sources, compile_plan
from cleargrain.operators.preview import Preview, preview_node
from cleargrain.operators.verify import Provenance, verify
from cleargrain.plans.model import Plan
from cleargrain.sinks.store import Manifest, Store
from cleargrain.streaming.batches import Context, RunGate


@contextmanager
def supervised(spark: SparkSession, context: Context, every: float = 0.1) -> Iterator[None]:
    """Spark jobs started within are cancelled when the run is, or when its deadline passes."""
    tag, done, ended = f"cleargrain-{uuid.uuid4().hex}", threading.Event(), []

    def watch() -> None:
        while not done.wait(every):
            try:
                context.check()
            except CleaningError as error:
                ended.append(error)
                spark.sparkContext.cancelJobsWithTag(tag)  # again each time: a job may start after the first call

    context.check()
    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        with sanitised():
            yield
    except CleaningError:
        if ended:
            raise ended[0] from None
        context.check()
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
    if ended:
        raise ended[0]


class Engine:
    def __init__(self, spark: SparkSession, sources: Sources, store: Store, session: Session | None = None, gate: RunGate | None = None):
        self.spark, self.sources, self.store = spark, sources, store
        self.session, self.gate = session or Session("session"), gate or RunGate()

    def materialize(self, plan: Plan, id: str, order: list[str] | None = None, context: Context | None = None, quality: int | None = None) -> Manifest:
        """The plan's rows as a snapshot; one that fails, is cancelled or is late leaves nothing."""
        with self.gate:
            r = compile_plan(plan, self.sources)
            with supervised(self.spark, context or Context()):
                made = self.store.publish(id, r.df, r.schema, order, (plan.fingerprint(),), quality)
        self.session.snapshot_materialized(id, made.rows)
        return made

    def verify(self, plan: Plan, id: str, order_keys: list[str], provenance: Provenance | None = None, context: Context | None = None) -> dict[str, Manifest]:
        """Accepted rows and all reports as one bundle."""
        with self.gate, supervised(self.spark, context or Context()):
            made = self.store.publish_bundle(id, verify(plan, self.sources, order_keys, provenance))
        self.session.snapshot_materialized(id, made["accepted"].rows)
        return made

    def preview(self, plan: Plan, target: str, context: Context | None = None, **how) -> Preview:
        if target not in plan.nodes:
            fail(Category.NOT_FOUND, "no such node")
        with supervised(self.spark, context or Context()):
            return preview_node(plan, self.sources, target, **how)
