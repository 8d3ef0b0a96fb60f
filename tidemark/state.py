"""Small driver-side state (values by namespace and key), and a checkpoint file that is replaced whole."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .storage import read_bytes, write_bytes


class KeyValueStore:
    def __init__(self):
        self._spaces: dict[str, dict] = {}

    def namespace(self, name: str) -> dict:
        return self._spaces.setdefault(name, {})

    def get(self, name: str, key, default=None):
        return self._spaces.get(name, {}).get(key, default)

    def put(self, name: str, key, value) -> None:
        self.namespace(name)[key] = value

    def pop(self, name: str, key, default=None):
        return self._spaces.get(name, {}).pop(key, default)

    def items(self, name: str) -> Iterator[tuple]:
        return iter(list(self._spaces.get(name, {}).items()))

    def dump(self) -> dict[str, dict]:
        return {k: dict(v) for k, v in self._spaces.items()}

    def load(self, spaces: dict[str, dict]) -> None:
        self._spaces = {k: dict(v) for k, v in spaces.items()}

    def clear(self) -> None:
        self._spaces.clear()


def save_checkpoint(spark: SparkSession, folder: str, store: KeyValueStore, offsets: dict, tables: dict[str, str] | None = None) -> None:
    """State, offsets and the places of state tables together, or none of them."""
    write_bytes(spark, f"{folder}/state.bin", pickle.dumps({"spaces": store.dump(), "offsets": dict(offsets), "tables": dict(tables or {})}))


def load_checkpoint(spark: SparkSession, folder: str) -> tuple[KeyValueStore, dict, dict[str, str]]:
    """What was saved; empty if nothing was."""
    store, held = KeyValueStore(), read_bytes(spark, f"{folder}/state.bin")
    if held is None:
        return store, {}, {}
    found = pickle.loads(held)
    store.load(found["spaces"])
    return store, found["offsets"], found["tables"]
