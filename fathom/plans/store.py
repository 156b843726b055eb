"""Versioned datasets: immutable Parquet folders and one manifest a version.

A commit writes what changed to new folders and then creates the next manifest, which fails if another writer was
first; readers pin a manifest, so a statement or transaction sees one version of tables, points, edges and series. All
files are reached through the session's Hadoop file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fathom.errors import EngineError, require

#: Receipts of idempotent requests are kept so many seconds.
RECEIPT_SECONDS = 24 * 3600


class Files:
    """A few operations on a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does."""
        done = self.path(name)
        if self.fs.exists(done):
            return False
        draft = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if not self.fs.exists(done) and self.fs.rename(draft, done):
                return True
        except self.jvm.java.io.IOException:
            pass
        self.fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Manifest:
    """One version: dataset name to its folder, schema and what kind of thing it is; receipts by key."""

    version: int = 0
    datasets: dict[str, dict] = field(default_factory=dict)
    receipts: dict[str, dict] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "datasets": self.datasets, "receipts": self.receipts})


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(self.files.read(f"manifests/v{version:012d}.json"))) if version else Manifest()

    def read(self, m: Manifest, name: str) -> DataFrame:
        require(name in m.datasets, "not_found", f"no dataset {name}")
        own = m.datasets[name]
        return self.spark.read.schema(T.StructType.fromJson(own["schema"])).parquet(f"{self.files.root}/{own['path']}")

    def write(self, name: str, df: DataFrame, kind: str, meta: dict) -> dict:
        path = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.files.root}/{path}")
        return {"path": path, "schema": json.loads(df.schema.json()), "kind": kind, "meta": meta}

    def publish(self, base: Manifest, datasets: dict[str, dict], receipts: dict[str, dict]) -> Manifest:
        new = Manifest(base.version + 1, datasets, receipts)
        if not self.files.create(f"manifests/v{new.version:012d}.json", new.text()):
            raise EngineError("40001", "another commit came first; retry on the new version")
        return new

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    # snapshots and upkeep

    def snapshot(self, label: str) -> int:
        m = self.manifest()
        require(self.files.create(f"snapshots/{label}.json", json.dumps({"version": m.version})), "snapshot_exists", label)
        return m.version

    def restore(self, label: str) -> Manifest:
        """Publish the snapshot's datasets as the newest version; nothing is copied, for folders never change."""
        then = self.manifest(json.loads(self.files.read(f"snapshots/{label}.json"))["version"])
        now = self.manifest()
        return self.publish(now, then.datasets, now.receipts)

    def compact(self, name: str, partitions: int) -> Manifest:
        """Rewrite a dataset into fewer, larger files."""
        m = self.manifest()
        own = m.datasets[name]
        new = self.write(name, self.read(m, name).repartition(partitions), own["kind"], own["meta"])
        return self.publish(m, {**m.datasets, name: new}, m.receipts)

    def prune(self, keep: int = 1) -> int:
        """Drop manifests but the last ``keep`` and those of snapshots, and folders that no kept one names."""
        kept = set(self.versions()[-keep:]) | {json.loads(self.files.read(f"snapshots/{s}"))["version"] for s in self.files.names("snapshots")}
        live = {d["path"] for v in kept for d in self.manifest(v).datasets.values()}
        gone = 0
        for v in self.versions():
            if v not in kept:
                self.files.delete(f"manifests/v{v:012d}.json")
        for name in self.files.names("data"):
            for part in self.files.names(f"data/{name}"):
                if f"data/{name}/{part}" not in live:
                    self.files.delete(f"data/{name}/{part}")
                    gone += 1
        return gone


class Transaction:
    """Staged changes over a pinned version: snapshot isolation, savepoints, one atomic commit."""

    def __init__(self, store: Store, base: Manifest) -> None:
        self.store, self.base = store, base
        self.datasets: dict[str, dict] = dict(base.datasets)
        self.staged: dict[str, tuple[DataFrame, str, dict]] = {}
        self.savepoints: list[tuple[str, dict, dict]] = []

    def names(self, kind: str | None = None) -> list[str]:
        own = {n: d["kind"] for n, d in self.datasets.items()} | {n: k for n, (_, k, _) in self.staged.items()}
        return sorted(n for n, k in own.items() if kind in (None, k))

    def has(self, name: str) -> bool:
        return name in self.staged or name in self.datasets

    def read(self, name: str) -> DataFrame:
        if name in self.staged:
            return self.staged[name][0]
        require(name in self.datasets, "not_found", f"no dataset {name}")
        return self.store.read(Manifest(self.base.version, self.datasets), name)

    def meta(self, name: str) -> dict:
        return self.staged[name][2] if name in self.staged else self.datasets[name]["meta"]

    def kind(self, name: str) -> str:
        return self.staged[name][1] if name in self.staged else self.datasets[name]["kind"]

    def put(self, name: str, df: DataFrame, kind: str | None = None, meta: dict | None = None) -> None:
        self.staged[name] = (df, kind or self.kind(name), self.meta(name) if meta is None else meta)

    def drop(self, name: str) -> None:
        require(self.has(name), "not_found", f"no dataset {name}")
        self.staged.pop(name, None)
        self.datasets.pop(name, None)

    def savepoint(self, name: str) -> None:
        self.savepoints.append((name, dict(self.datasets), dict(self.staged)))

    def rollback_to(self, name: str) -> None:
        at = self._at(name)
        _, datasets, staged = self.savepoints[at]
        self.datasets, self.staged, self.savepoints = dict(datasets), dict(staged), self.savepoints[: at + 1]

    def release(self, name: str) -> None:
        self.savepoints = self.savepoints[: self._at(name)]

    def _at(self, name: str) -> int:
        found = [i for i, s in enumerate(self.savepoints) if s[0] == name]
        require(bool(found), "3B001", f"no savepoint {name}")
        return found[-1]

    def commit(self, receipt: tuple[str, Mapping] | None = None) -> Manifest:
        """Write what is staged, then publish. A receipt (key, result) makes a retry of the request a no-op."""
        now = time.time()
        receipts = {k: r for k, r in self.base.receipts.items() if now - r["at"] < RECEIPT_SECONDS}
        if receipt:
            receipts[receipt[0]] = {"at": now, "result": dict(receipt[1])}
        new = {n: self.store.write(n, df, kind, meta) for n, (df, kind, meta) in self.staged.items()}
        return self.store.publish(self.base, {**self.datasets, **new}, receipts)
