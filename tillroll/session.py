"""Spark session helpers."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session configured the way the library expects: UTC, AQE on, no UI."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("tillroll")
        .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: stored tables take little disk, and the shuffles that made them go with the job
STORED = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def stored_writes(spark: SparkSession) -> Iterator[None]:
    """Inside, tables are written as zstd, and a job's shuffle files are deleted when it ends: else they stay until
    the driver happens to collect its garbage."""
    before = {k: spark.conf.get(k, None) for k in STORED}
    try:
        for k, v in STORED.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_LOCAL_FALLBACK: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master (tests) gets a scratch folder of its own where the
    setting is missing; a cluster without a shared folder is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_FALLBACK.get("dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL_FALLBACK["dir"] = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
