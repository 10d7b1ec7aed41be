"""Source kinds, what each can do, and requests that are refused rather than quietly weakened."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cleargrain.errors import Category, fail, secret_key, secret_value
from cleargrain.operators.preview import Preview, preview
from cleargrain.plans.types import LogicalSchema
from cleargrain.sinks.files import Files
from cleargrain.sinks.store import export
from cleargrain.sources import tabular, workbook

#: Fixed limits of discovery and of object keys.
DEPTH, MAX_DEPTH, ASSETS, MAX_ASSETS, KEY_BYTES, OBJECT_BYTES = 16, 64, 10_000, 100_000, 1024, 1 << 40


@dataclass(frozen=True)
class Capabilities:
    discovery: bool = True
    preview: bool = True
    streaming: bool = True
    projection: bool = True
    predicate: bool = False
    range: bool = False
    incremental: bool = False
    change_tracking: bool = False


#: Kind of source -> what it can do. The last two are known and refused.
KINDS: dict[str, Capabilities | None] = {"local_tabular": Capabilities(), "object_store": Capabilities(range=True), "workbook": Capabilities(), "sql_database": None, "document": None}


@dataclass(frozen=True)
class Connection:
    """kind, options without secrets, and the name under which credentials are kept elsewhere."""

    kind: str
    root: str
    options: dict[str, str] = field(default_factory=dict)
    credential: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            fail(Category.INVALID_REQUEST, "no such source kind")
        if any(secret_key(k) or secret_value(v) for k, v in self.options.items()) or secret_value(self.root):
            fail(Category.INVALID_REQUEST, "a connection holds a secret; name a credential instead")


@dataclass(frozen=True)
class Asset:
    path: str
    kind: str
    sheet: str | None = None
    #: What an object's files were when it was listed.
    version: str | None = None


def capabilities(connection: Connection) -> Capabilities:
    return KINDS[connection.kind] or fail(Category.UNSUPPORTED, "the source kind isn't supported")


def require(connection: Connection, *names: str) -> None:
    able = capabilities(connection)
    for name in names:
        if not getattr(able, name):
            fail(Category.UNSUPPORTED, f"the source can't do {name}")


def object_key(key: str) -> str:
    """A key that stays under its prefix."""
    if not key or len(key.encode()) > KEY_BYTES or key.startswith("/") or re.search(r"(^|/)\.\.?(/|$)|\x00|//", key):
        fail(Category.INVALID_REQUEST, "an object key is out of bounds")
    return key


def test_connection(spark: SparkSession, connection: Connection) -> None:
    capabilities(connection)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(connection.root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fail(Category.NOT_FOUND, "the source's root isn't there")


def discover(connection: Connection, depth: int = DEPTH, most: int = ASSETS) -> list[Asset]:
    """Files of known formats below the root, sorted; too many fail, links aren't followed."""
    require(connection, "discovery")
    if not 0 < depth <= MAX_DEPTH or not 0 < most <= MAX_ASSETS:
        fail(Category.INVALID_REQUEST, "a discovery is out of range")
    if connection.kind == "object_store":
        return _objects(connection, depth, most)
    root = Path(connection.root.removeprefix("file://"))
    if not root.is_dir() or root.is_symlink():
        fail(Category.NOT_FOUND, "the root isn't a folder")
    out: list[Asset] = []
    stack = [(root, 1)]
    while stack:
        at, level = stack.pop()
        for entry in sorted(os.scandir(at), key=lambda e: e.name):
            if entry.is_symlink():
                continue
            if entry.is_dir():
                if level >= depth:
                    fail(Category.LIMIT_EXCEEDED, "folders are nested too deeply")
                stack.append((Path(entry.path), level + 1))
                continue
            suffix = Path(entry.name).suffix.lower()
            if connection.kind == "workbook" and suffix in workbook.READABLE:
                out += [Asset(entry.path, "workbook", s) for s in workbook.sheet_names(entry.path)]
            elif connection.kind != "workbook" and suffix in tabular.FORMATS:
                out.append(Asset(entry.path, tabular.FORMATS[suffix]))
            if len(out) > most:
                fail(Category.LIMIT_EXCEEDED, "there are too many assets")
    return sorted(out, key=lambda a: (a.path, a.sheet or ""))


def _parts(files: Files, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of the files of an object, which may be a folder of parts."""
    inner = files.entries(path)
    found = inner if inner and (len(inner) > 1 or inner[0].name != path.rsplit("/", 1)[-1]) else [e for e in files.entries(path.rsplit("/", 1)[0]) if e.name == path.rsplit("/", 1)[-1]]
    return [(e.name, e.bytes, e.changed) for e in found if not e.folder]


def _version(files: Files, path: str) -> str:
    parts = _parts(files, path)
    if not parts:
        fail(Category.NOT_FOUND, "the object isn't there")
    if sum(n for _, n, _ in parts) > OBJECT_BYTES:
        fail(Category.LIMIT_EXCEEDED, "an object is too large")
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def _objects(connection: Connection, depth: int, most: int) -> list[Asset]:
    """Objects of known formats below the root on any file system that Spark reaches; a folder named like a file is one object."""
    spark = SparkSession.getActiveSession() or fail(Category.INVALID_REQUEST, "objects are listed by a session")
    files, root = Files(spark), connection.root.rstrip("/")
    if not files.exists(root):
        fail(Category.NOT_FOUND, "the root isn't there")
    out: list[Asset] = []
    stack = [(root, 1)]
    while stack:
        at, level = stack.pop()
        for e in files.entries(at):
            path, suffix = f"{at}/{e.name}", Path(e.name).suffix.lower()
            if suffix in tabular.FORMATS:
                object_key(path[len(root) + 1 :])
                out.append(Asset(path, tabular.FORMATS[suffix], None, _version(files, path)))
            elif e.folder:
                if level >= depth:
                    fail(Category.LIMIT_EXCEEDED, "folders are nested too deeply")
                stack.append((path, level + 1))
            if len(out) > most:
                fail(Category.LIMIT_EXCEEDED, "there are too many assets")
    return sorted(out, key=lambda a: a.path)


def upload(spark: SparkSession, connection: Connection, key: str, df: DataFrame, kind: str) -> Asset:
    """Rows as an object under the root, never over another; the file system's client uploads in parts."""
    if connection.kind != "object_store":
        fail(Category.UNSUPPORTED, "the source kind takes no uploads")
    path = f"{connection.root.rstrip('/')}/{object_key(key)}"
    export(df, path, kind)
    return Asset(path, tabular.format_of(path), None, _version(Files(spark), path))


def read_asset(spark: SparkSession, connection: Connection, asset: Asset, projection: list[str] | None = None, schema: LogicalSchema | None = None, options: tabular.Options | None = None, selection: workbook.Selection | None = None) -> tuple[DataFrame, LogicalSchema]:
    """An asset's rows and schema; an object must be as it was when it was listed."""
    require(connection, "streaming", *(["projection"] if projection else []))
    if asset.version is not None and _version(Files(spark), asset.path) != asset.version:
        fail(Category.SCHEMA_DRIFT, "the object has changed since it was listed")
    if asset.kind == "workbook":
        df, found = workbook.read(spark, asset.path, asset.sheet, selection or fail(Category.INVALID_REQUEST, "a workbook needs a region"))
        return (df.select(*projection) if projection else df), found
    return tabular.read(spark, asset.path, projection, schema, options, asset.kind)


def preview_asset(spark: SparkSession, connection: Connection, asset: Asset, rows: int = 1000, **how) -> Preview:
    require(connection, "preview")
    df, schema = read_asset(spark, connection, asset, **how)
    return preview(df, schema, rows)


def checkpoint(connection: Connection) -> None:
    """No source can resume."""
    require(connection, "incremental")
