"""Datasets by id: who owns them, who may see them, how they are read."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable
from contextlib import closing
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from concord.files import remove
from concord.sources import tables
from concord.types import declared

PUBLIC, PRIVATE = "PUBLIC", "PRIVATE"


@dataclass
class Dataset:
    """driver: csv, parquet, sqlite, jdbc, image or view; source: its path, URL or view name."""

    id: str
    driver: str
    source: str
    party: str = ""
    description: str = ""
    visibility: str = PUBLIC
    schema: list[dict] = field(default_factory=list)
    options: dict = field(default_factory=dict)


class JsonStore:
    """Entries in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def save(self, entries: list[dict]) -> None:
        part = self.path.with_suffix(".tmp")
        part.write_text(json.dumps(entries, indent=1))
        part.replace(self.path)


class KeyValueStore:
    """Entries by id in a SQLite file."""

    def __init__(self, path: str):
        self.path = path
        with closing(sqlite3.connect(path)) as db, db:
            db.execute("CREATE TABLE IF NOT EXISTS meta (id TEXT PRIMARY KEY, entry TEXT)")

    def load(self) -> list[dict]:
        with closing(sqlite3.connect(self.path)) as db:
            return [json.loads(x) for (x,) in db.execute("SELECT entry FROM meta ORDER BY rowid")]

    def save(self, entries: list[dict]) -> None:
        with closing(sqlite3.connect(self.path)) as db, db:
            db.execute("DELETE FROM meta")
            db.executemany("INSERT INTO meta VALUES (?, ?)", [(e["id"], json.dumps(e)) for e in entries])


STORES = {"json": JsonStore, "kv": KeyValueStore}


class Catalog:
    """Datasets in memory, with an optional store (a JSON file, or with backend kv a SQLite file) that is read at start and kept up to date."""

    def __init__(self, spark: SparkSession, path: str | None = None, backend: str = "json"):
        if backend not in STORES:
            raise ValueError(f"no such backend: {backend}")
        self.spark, self.entries = spark, {}
        self.store = STORES[backend](path) if path else None
        for x in self.store.load() if self.store else ():
            self.entries[x["id"]] = Dataset(**x)

    def _save(self) -> None:
        if self.store:
            self.store.save([asdict(e) for e in self.entries.values()])

    def register(self, entry: Dataset) -> Dataset:
        if entry.visibility not in (PUBLIC, PRIVATE):
            raise ValueError(f"no such visibility: {entry.visibility}")
        if entry.driver not in readers():
            raise ValueError(f"no such driver: {entry.driver}")
        self.entries[entry.id] = entry
        self._save()
        return entry

    def update(self, entry: Dataset) -> Dataset:
        self.find(entry.id)
        return self.register(entry)

    def unregister(self, dataset_id: str) -> None:
        """Removes the entry; the data stay where they are."""
        self.find(dataset_id)
        del self.entries[dataset_id]
        self._save()

    def find(self, dataset_id: str, party: str | None = None) -> Dataset:
        """party: who asks; a private dataset is found by its owner alone."""
        e = self.entries.get(dataset_id)
        if e is None or (e.visibility == PRIVATE and party is not None and party != e.party):
            raise KeyError(f"no such dataset: {dataset_id}")
        return e

    def list(self, ids: list[str] | None = None, party: str | None = None) -> list[Dataset]:
        """All, or those with the ids, that the party may see."""
        return [e for e in self.entries.values() if (not ids or e.id in ids) and (e.visibility == PUBLIC or party in (None, e.party))]

    def read(self, dataset_id: str, columns: list[str] | None = None, party: str | None = None) -> DataFrame:
        e = self.find(dataset_id, party)
        df = readers()[e.driver](self.spark, e.source, declared(e.schema) if e.schema else None, e.options)
        return df.select(*columns) if columns else df

    def put(self, dataset_id: str, df: DataFrame, **about) -> Dataset:
        """Registers a frame as a temporary view."""
        view = "ds_" + "".join(c if c.isalnum() else "_" for c in dataset_id)
        df.createOrReplaceTempView(view)
        return self.register(Dataset(dataset_id, "view", view, **about))

    def upload(self, dataset_id: str, df: DataFrame, path: str, **about) -> Dataset:
        """Writes a frame as Parquet and registers it."""
        df.write.mode("overwrite").parquet(path)
        return self.register(Dataset(dataset_id, "parquet", path, **about))

    def download(self, dataset_id: str, path: str, party: str | None = None) -> str:
        """Writes a dataset as CSV with a header."""
        tables.write_csv(self.read(dataset_id, party=party), path)
        return path

    def drop(self, dataset_id: str, data: bool = False) -> None:
        """Removes the entry and, for a view, the view; with data, the files of a file-based dataset too."""
        e = self.find(dataset_id)
        if e.driver == "view":
            self.spark.catalog.dropTempView(e.source)
        elif data and e.driver in ("csv", "parquet", "sqlite", "image"):
            remove(e.source)
        self.unregister(dataset_id)

    def load_defaults(self, path: str) -> list[Dataset]:
        """Registers datasets listed in a JSON file (or YAML, where that library is there)."""
        text = Path(path).read_text()
        try:
            listed = json.loads(text)
        except ValueError:
            import yaml

            listed = yaml.safe_load(text)
        listed = listed.get("datasets", listed) if isinstance(listed, dict) else listed
        return [
            self.register(
                Dataset(
                    x.get("id") or x["description"], x.get("driver") or x["model"], x["source"], x.get("party", ""), x.get("description", ""),
                    x.get("visibility", PUBLIC), x.get("schema", []), {"table": x["table_name"]} if "table_name" in x else x.get("options", {}),
                )
            )
            for x in listed
        ]


def readers() -> dict[str, Callable]:
    return {
        "csv": tables.read_csv,
        "parquet": tables.read_parquet,
        "sqlite": tables.read_sqlite,
        "jdbc": tables.read_jdbc,
        "mysql": tables.read_jdbc,
        "image": tables.read_images,
        "view": lambda spark, source, schema, options: spark.table(source),
    }
