"""Versioned Parquet tables: every save is a new directory; the newest complete one is the table.

A version is complete when its ``_SUCCESS`` marker is there, which the committer writes last, so a reader meets the
version before or the version after a save and a failed save leaves the table as it was. A version is never overwritten.
A save may write some partitions only: the version then says in which earlier versions the others lie. After
``MOST_VERSIONS`` such saves the next one writes the whole table again. File operations go through Hadoop's file system,
so the path may be on any shared store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"v\d{8,}")
#: Where the state of a table without versions is kept.
_NOTHING = "v00000000"
#: Versions that a table may lie in before a save writes it whole.
MOST_VERSIONS = 16


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: str | None = None, compression: str = "zstd"):
        self.spark, self.path, self.partition_by, self.compression = spark, path.rstrip("/"), partition_by, compression

    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, complete: bool = True) -> list[str]:
        fs, root = self._fs("")
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and _VERSION.fullmatch(s.getPath().getName()))
        return [n for n in names if not complete or fs.exists(self._fs(f"{n}/_SUCCESS")[1])]

    def current(self) -> str | None:
        """The current version's name, None before the first save."""
        return next(reversed(self._versions()), None)

    def save(self, df: DataFrame, state: dict[str, Any] | None = None) -> str:
        """Write a new version of the whole table; ``state`` is kept with it and becomes current with it."""
        return self._save(df, state, None)

    def save_partitions(self, df: DataFrame, names: Iterable[str], state: dict[str, Any] | None = None) -> str:
        """Write a new version in which the partitions ``names`` hold the rows ``df`` and the others what they held."""
        now = self.current()
        parts = self._parts(now) if now else {}
        if len(set(parts.values())) >= MOST_VERSIONS:
            rest = self.load().where(~F.col(self.partition_by).isin(list(names)))
            return self._save(df.unionByName(rest.select(*df.columns)), state, None)
        return self._save(df, state, {**parts, **dict.fromkeys(names)})

    def _save(self, df: DataFrame, state: dict[str, Any] | None, parts: dict[str, str | None] | None) -> str:
        taken = self._versions(complete=False)
        name = f"v{(int(taken[-1][1:]) if taken else 0) + 1:08d}"
        if state is not None or parts is not None:
            self._write_state(name, state, None if parts is None else {k: v or name for k, v in parts.items()})
        writer = df.write.mode("errorifexists").option("compression", self.compression)
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{name}")
        return name

    def _parts(self, version: str) -> dict[str, str]:
        """The version in which each partition of this version lies."""
        kept = (self._kept(version) or {}).get("parts")
        if kept is not None:
            return kept
        fs, p = self._fs(version)
        names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return {n.split("=", 1)[1]: version for n in names if n.startswith(f"{self.partition_by}=")}

    def _states(self, version: str) -> list[str]:
        fs, root = self._fs("")
        if not fs.exists(root):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(root))
        return sorted(n for n in names if n.startswith(f"state-{version}-") and n.endswith(".json"))

    def _write_state(self, version: str, state: dict[str, Any] | None, parts: dict[str, str] | None) -> None:
        taken = self._states(version)
        number = int(taken[-1][:-5].rsplit("-", 1)[1]) + 1 if taken else 0
        fs, part = self._fs(f".state-{version}-{number:06d}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps({"state": state, "parts": parts}).encode()))
        finally:
            out.close()
        fs.rename(part, self._fs(f"state-{version}-{number:06d}.json")[1])

    def save_state(self, state: dict[str, Any]) -> None:
        """Keep another ``state`` with the current version (or with the empty table) without writing its rows again."""
        version = self.current() or _NOTHING
        self._write_state(version, state, (self._kept(version) or {}).get("parts"))

    def _kept(self, version: str) -> dict[str, Any] | None:
        names = self._states(version)
        if not names:
            return None
        fs, p = self._fs(names[-1])
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self, version: str | None = None) -> dict[str, Any] | None:
        """What was last kept with the current (or a given) version."""
        return (self._kept(version or self.current() or _NOTHING) or {}).get("state")

    def load(self, schema: str | None = None, version: str | None = None) -> DataFrame | None:
        """The current (or a given) version; None if nothing was saved."""
        name = version or self.current()
        if name is None:
            return None
        parts = (self._kept(name) or {}).get("parts")
        found = None
        for v in sorted(set(parts.values())) if parts else [name]:
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            rows = reader.parquet(f"{self.path}/{v}")
            if parts:
                rows = rows.where(F.col(self.partition_by).isin([k for k, at in parts.items() if at == v]))
            found = rows if found is None else found.unionByName(rows)
        return found

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` complete versions and those that they refer to, and what failed saves left."""
        kept = self._versions()[-keep:] if keep else []
        needed = {*kept, *(v for k in kept for v in ((self._kept(k) or {}).get("parts") or {}).values())}
        gone = [n for n in self._versions(complete=False) if n not in needed and (not kept or n < kept[-1])]
        for n in gone:
            for name in (n, *self._states(n)):
                fs, p = self._fs(name)
                fs.delete(p, True)
        return gone
