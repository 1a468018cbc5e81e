"""Parquet datasets that are replaced as a whole, never in place.

A write goes to a folder of its own; when all its files are there, a small manifest that names the
folders of the new version is put beside the earlier ones by a rename.  Readers take the newest
manifest, so a job that fails or dies while it writes leaves the dataset as it was, and a reader that
has begun keeps its files until ``vacuum``.  Of two writers that start from the same version, the
second to finish is refused.

Layout of ``path``:

    data/__commit=<id>/[<column>=<value>/]part-*.parquet
    versions/<number>.json      {"schema", "partition_by", "folders", "properties"}

A partitioned dataset can replace some of its partitions: the new version keeps the folders of the
others.  Everything goes through the path's Hadoop FileSystem, so any shared store does.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillroll.session import stored_writes

COMMIT = "__commit"


class Conflict(RuntimeError):
    """Another writer has replaced the version that this write started from."""


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, inside: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inside}".rstrip("/"))

    def _children(self, inside: str) -> list[str]:
        folder = self._hadoop(inside)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    # ── versions ─────────────────────────────────────────────────────────
    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._children("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        version = version if version is not None else (known[-1] if known else None)
        if version is None:
            return None
        if version not in known:
            raise FileNotFoundError(f"{self.path}: version {version}")
        stream = self._fs.open(self._hadoop(f"versions/{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _commit(self, base: dict | None, df: DataFrame, partition_by: str | None, folders: list[str], properties: dict) -> int:
        version = base["version"] + 1 if base else 1
        body = json.dumps({"schema": df.schema.jsonValue(), "partition_by": partition_by, "folders": sorted(folders),
                           "properties": (base or {}).get("properties", {}) | properties})
        final, draft = self._hadoop(f"versions/{version:012d}.json"), self._hadoop(f"versions/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(body, "utf-8"))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path}: version {version} exists already")
        return version

    def _write(self, df: DataFrame, partition_by: str | None, order: list[str], even: bool = True) -> list[str]:
        """The folders of a new commit, relative to ``data``; rows in ``order`` inside each file."""
        folder = f"{COMMIT}={uuid.uuid4().hex}"
        with stored_writes(df.sparkSession):
            if partition_by is None:
                (df.sortWithinPartitions(*order) if order else df).write.parquet(f"{self.path}/data/{folder}")
                return [folder]
            # AQE rebalance: evenly sized files per partition value; a hot value is split across tasks
            rows = (df.hint("rebalance", partition_by) if even else df).sortWithinPartitions(partition_by, *order)
            rows.write.partitionBy(partition_by).parquet(f"{self.path}/data/{folder}")
        return [f"{folder}/{name}" for name in self._children(f"data/{folder}") if "=" in name]

    # ── writing ──────────────────────────────────────────────────────────
    def overwrite(self, df: DataFrame | list[DataFrame], partition_by: str | None = None, properties: dict | None = None, order: tuple[str, ...] = (), even: bool = True) -> int:
        """The rows of ``df`` are the next version; its number is returned.  ``even=False``: no shuffle to even out files.

        A list holds portions of the rows, written one after the other."""
        base, portions = self.manifest(), df if isinstance(df, list) else [df]
        folders = [f for p in portions for f in self._write(p, partition_by, [*order], even)]
        return self._commit(base, portions[0], partition_by, folders, properties or {})

    def replace(self, df: DataFrame | list[DataFrame], values: list, properties: dict | None = None, order: tuple[str, ...] = (), even: bool = True) -> int:
        """The rows of ``df`` take the place of the partitions ``values``; a value without rows goes."""
        base = self.manifest()
        if base is None or base["partition_by"] is None:
            raise ValueError("only partitions of a partitioned dataset can be replaced")
        column = base["partition_by"]
        gone = {f"{column}={v}" for v in values}
        portions = df if isinstance(df, list) else [df]
        new = [f for p in portions for f in self._write(p.select(*[x["name"] for x in base["schema"]["fields"]]), column, [*order], even)]
        strange = {f.split("/")[1] for f in new} - gone
        if strange:
            raise ValueError(f"rows outside the partitions to replace: {sorted(strange)[:5]}")
        kept = [f for f in base["folders"] if f.split("/")[1] not in gone]
        return self._commit(base, portions[0], column, kept + new, properties or {})

    # ── reading ──────────────────────────────────────────────────────────
    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(self.path)
        schema = T.StructType.fromJson(found["schema"])
        if not found["folders"]:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.path}/data").schema(schema.add(COMMIT, "string"))
        return reader.parquet(*[f"{self.path}/data/{f}" for f in found["folders"]]).select(*[f["name"] for f in found["schema"]["fields"]])

    # ── housekeeping ─────────────────────────────────────────────────────
    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep`` and the commits that only they use; the number of commits deleted.

        To be run when no reader of an older version and no writer is left."""
        versions = self.versions()
        used = {f.split("/")[0] for v in versions[-keep:] for f in self.manifest(v)["folders"]}
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"versions/{v:012d}.json"), False)
        unused = [c for c in self._children("data") if c.startswith(f"{COMMIT}=") and c not in used]
        for commit in unused:
            self._fs.delete(self._hadoop(f"data/{commit}"), True)
        return len(unused)
