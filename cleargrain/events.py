"""An audit log of what was connected to, found, read and published. Its text holds no secrets and no cell values."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from cleargrain.errors import Category, fail, secret_key, secret_value

#: What an event is about, and what happened to it.
OBJECTS = ("session", "source_connection", "source_asset", "dataset", "snapshot", "capability")
HAPPENINGS = ("tested", "failed", "discovered", "inspected", "imported", "materialized", "completed")


@dataclass(frozen=True)
class Event:
    id: str
    session: str
    kind: str
    object: str
    happened: str
    at: float
    metadata: dict[str, str | int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in OBJECTS or self.happened not in HAPPENINGS:
            fail(Category.INVALID_REQUEST, "no such event")
        if any(secret_key(k) or (isinstance(v, str) and secret_value(v)) for k, v in self.metadata.items()):
            fail(Category.INVALID_REQUEST, "an event holds a secret")

    def json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class Session:
    """A session's events, in order; ids and times come from functions that are given, so that runs can be repeated."""

    def __init__(self, name: str, clock: Callable[[], float] = time.time, ids: Callable[[], str] = lambda: str(uuid.uuid4())):
        self.name, self.clock, self.ids = name, clock, ids
        self.events: list[Event] = []

    def _add(self, kind: str, object: str, happened: str, **metadata: str | int) -> Event:
        self.events.append(Event(self.ids(), self.name, kind, object, happened, self.clock(), metadata))
        return self.events[-1]

    def connection_tested(self, connection: str) -> Event:
        return self._add("source_connection", connection, "tested")

    def connection_failed(self, connection: str, category: Category) -> Event:
        return self._add("source_connection", connection, "failed", category=category.value[0])

    def asset_discovered(self, connection: str, asset: str) -> Event:
        return self._add("source_asset", asset, "discovered", connection=connection)

    def asset_inspected(self, asset: str, columns: int) -> Event:
        return self._add("source_asset", asset, "inspected", columns=columns)

    def dataset_imported(self, dataset: str) -> Event:
        return self._add("dataset", dataset, "imported")

    def snapshot_materialized(self, snapshot: str, rows: int) -> Event:
        return self._add("snapshot", snapshot, "materialized", rows=rows)

    def completed(self) -> Event:
        return self._add("session", self.name, "completed")
