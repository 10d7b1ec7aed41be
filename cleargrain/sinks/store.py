"""Snapshots and verification bundles: immutable Parquet folders that become visible by one rename of a manifest.

Writers write to a staging folder, rename it, and put the manifest in its place last; what no manifest names is not there, and
`recover` removes it. Spark writes and reads the data and digests its files, a task for each few files; the manifest holds counts,
sizes and digests. The store's root is a folder of any file system that the driver and all executors see.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.errors import Category, CleaningError, fail, sanitised
from cleargrain.functions.expressions import quoted
from cleargrain.operators.verify import Verified
from cleargrain.plans.types import LogicalSchema
from cleargrain.sinks.files import Files

#: Fixed limits of a snapshot, and of readers and publishers of a store at once.
MAX_ROWS, MAX_BYTES, MAX_PARTITIONS, READERS, PUBLISHERS = 1_000_000_000, 1 << 40, 16_384, 64, 8
SECTIONS = ("accepted", "validation_summary", "validation_findings", "rejected", "dedup_summary", "duplicate_findings")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")

@dataclass(frozen=True)
class Manifest:
    id: str
    schema_fingerprint: str
    rows: int
    bytes: int
    files: tuple[tuple[str, int, str], ...]  # name, bytes, SHA-256
    schema: dict = field(default_factory=dict)
    lineage: tuple[str, ...] = ()
    quality: int | None = None

    def json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, default=list)

    @staticmethod
    def of(text: str) -> Manifest:
        body = json.loads(text)
        return Manifest(**body | {"files": tuple(tuple(f) for f in body["files"]), "lineage": tuple(body["lineage"])})


class Store:
    """root/snapshots/ID/data and root/bundles/ID/SECTION hold files, root/manifests/snapshot/ID.json and so on what is visible, an
    ID.dead beside it the time at which it was made unreadable."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock, self.files = spark, root.rstrip("/"), clock, Files(spark)
        for part in ("staging", "snapshots", "bundles", "manifests/snapshot", "manifests/bundle"):
            self.files.make(f"{self.root}/{part}")
        self._readers, self._publishers = threading.BoundedSemaphore(READERS), threading.BoundedSemaphore(PUBLISHERS)

    def _name(self, id: str) -> str:
        return id if _ID.fullmatch(id) else fail(Category.INVALID_REQUEST, "an id has odd characters")

    def _entry(self, table: str, id: str, ending: str = "json") -> str:
        return f"{self.root}/manifests/{table}/{self._name(id)}.{ending}"

    def _digests(self, folder: str) -> dict[str, tuple[int, str]]:
        """Bytes and SHA-256 of each file of a section as it lies there; tasks read the files, and a file has 2 GiB at most."""
        if not any(e.name.endswith(".parquet") for e in self.files.entries(folder)):
            return {}
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(folder)
        found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest")).collect()  # a row for each file
        return {r["name"]: (r["length"], r["digest"]) for r in found}

    def _write(self, df: DataFrame, schema: LogicalSchema | None, folder: str, order: list[str] | None) -> Manifest:
        """Writes one section; the manifest's digests are those of the files as they lie there."""
        with sanitised():
            (df.sortWithinPartitions(*[quoted(c) for c in order]) if order else df).write.option("compression", "snappy").option("maxRecordsPerFile", 5_000_000).parquet(folder)
            found = self._digests(folder)
            rows = self.spark.read.parquet(folder).count() if found else 0
        size = sum(n for n, _ in found.values())
        if len(found) > MAX_PARTITIONS:
            fail(Category.LIMIT_EXCEEDED, "a snapshot has too many files")
        if rows > MAX_ROWS or size > MAX_BYTES:
            fail(Category.LIMIT_EXCEEDED, "a snapshot is too large")
        return Manifest("", schema.fingerprint() if schema else "", rows, size, tuple((name, *found[name]) for name in sorted(found)), schema.json() if schema else {})

    def _publish(self, table: str, id: str, make: Callable[[str], object]) -> object:
        entry = self._entry(table, id)
        if not self._publishers.acquire(blocking=False):
            fail(Category.BUSY, "too many publishers at once")
        staging, final = f"{self.root}/staging/{table}-{id}", f"{self.root}/{table}s/{id}"
        own = False
        try:
            if self.files.exists(entry) or self.files.exists(staging):
                fail(Category.INVALID_REQUEST, "the id is taken")
            own = True
            self.files.make(staging)
            body = make(staging)
            self.files.remove(final)  # of a publisher that stopped before it committed
            self.files.move(staging, final)
            text = body.json() if isinstance(body, Manifest) else json.dumps({k: m.json() for k, m in body.items()})
            self.files.write_text(entry, json.dumps({"created": self.clock(), "manifest": text}))  # from here it is visible
            return body
        except BaseException:
            if own:
                self.files.remove(staging)
            raise
        finally:
            self._publishers.release()

    def publish(self, id: str, df: DataFrame, schema: LogicalSchema, order: list[str] | None = None, lineage: tuple[str, ...] = (), quality: int | None = None) -> Manifest:
        """An immutable snapshot of the frame's rows."""
        if quality is not None and not 0 <= quality <= 100:
            fail(Category.INVALID_REQUEST, "a quality score is out of range")

        def make(folder: str) -> Manifest:
            m = self._write(df, schema, f"{folder}/data", order)
            return Manifest(id, m.schema_fingerprint, m.rows, m.bytes, m.files, m.schema, lineage, quality)

        return self._publish("snapshot", id, make)

    def publish_bundle(self, id: str, verified: Verified) -> dict[str, Manifest]:
        """Accepted rows and all reports at once; without rejections there is no rejected section."""

        def make(folder: str) -> dict[str, Manifest]:
            out = {}
            for section in SECTIONS:
                df = getattr(verified, section)
                if df is None or (section == "rejected" and df.isEmpty()):
                    continue
                out[section] = self._write(df, verified.schema if section == "accepted" else None, f"{folder}/{section}", None)
            return out

        return self._publish("bundle", id, make)

    def _manifest(self, table: str, id: str) -> str:
        entry = self._entry(table, id)
        if not self.files.exists(entry) or self.files.exists(self._entry(table, id, "dead")):
            fail(Category.NOT_FOUND, f"no such {table}")
        return json.loads(self.files.text(entry))["manifest"]

    def manifest(self, id: str) -> Manifest:
        return Manifest.of(self._manifest("snapshot", id))

    def bundle(self, id: str) -> dict[str, Manifest]:
        return {k: Manifest.of(m) for k, m in json.loads(self._manifest("bundle", id)).items()}

    def _read(self, folder: str, m: Manifest, verified: bool) -> DataFrame:
        if not self._readers.acquire(blocking=False):
            fail(Category.BUSY, "too many readers at once")
        try:
            if verified:
                self._check(folder, m)
            return self.spark.read.parquet(*[f"{folder}/{name}" for name, *_ in m.files]) if m.files else fail(Category.NOT_FOUND, "the section has no files")
        finally:
            self._readers.release()

    def read(self, id: str, verified: bool = False) -> DataFrame:
        """A snapshot's rows, from the files that its manifest names and no others."""
        return self._read(f"{self.root}/snapshots/{id}/data", self.manifest(id), verified)

    def read_section(self, id: str, section: str, verified: bool = False) -> DataFrame:
        found = self.bundle(id)
        if section not in found:
            fail(Category.NOT_FOUND, "the bundle has no such section")
        return self._read(f"{self.root}/bundles/{id}/{section}", found[section], verified)

    def _check(self, folder: str, m: Manifest) -> None:
        try:
            with sanitised():
                found = self._digests(folder)
        except CleaningError:
            fail(Category.STORAGE, "a file can't be read")
        if any(found.get(name) != (size, digest) for name, size, digest in m.files):
            fail(Category.STORAGE, "a file isn't what was published")

    def verify(self, id: str) -> None:
        """Reads every file of a snapshot again and compares digests and the number of rows."""
        m = self.manifest(id)
        self._check(f"{self.root}/snapshots/{id}/data", m)
        if m.files and self.read(id).count() != m.rows:
            fail(Category.STORAGE, "a snapshot has lost rows")

    def tombstone(self, id: str, table: str = "snapshot") -> None:
        """Makes a snapshot or bundle unreadable; its files go with `collect`."""
        table = "bundle" if table == "bundle" else "snapshot"
        self._manifest(table, id)
        self.files.write_text(self._entry(table, id, "dead"), json.dumps(self.clock()))

    def recover(self) -> list[str]:
        """Removes staging folders and folders that no manifest names; for a store without publishers."""
        gone = [f"staging/{e.name}" for e in self.files.entries(f"{self.root}/staging")]
        for table in ("snapshot", "bundle"):
            known = {e.name.removesuffix(".json") for e in self.files.entries(f"{self.root}/manifests/{table}")}
            gone += [f"{table}s/{e.name}" for e in self.files.entries(f"{self.root}/{table}s") if e.name not in known]
        for name in gone:
            self.files.remove(f"{self.root}/{name}")
        return sorted(gone)

    def collect(self, retention_s: float) -> list[str]:
        """Removes files of what has been dead for longer than the retention."""
        gone = []
        for table in ("snapshot", "bundle"):
            for e in self.files.entries(f"{self.root}/manifests/{table}"):
                id = e.name.removesuffix(".dead")
                if id != e.name and json.loads(self.files.text(self._entry(table, id, "dead"))) <= self.clock() - retention_s:
                    for path in (f"{self.root}/{table}s/{id}", self._entry(table, id), self._entry(table, id, "dead")):
                        self.files.remove(path)
                    gone.append(f"{table}/{id}")
        return sorted(gone)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Rows as CSV, TSV, JSON lines or Parquet; never over what is there."""
    writer = df.write.mode("errorifexists")
    with sanitised():
        match kind:
            case "csv" | "tsv":
                writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
            case "jsonl" | "ndjson":
                writer.option("ignoreNullFields", False).json(path)
            case "parquet":
                writer.option("compression", "snappy").parquet(path)
            case _:
                fail(Category.UNSUPPORTED, "no such export format")
