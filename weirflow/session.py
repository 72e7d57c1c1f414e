"""Session helpers: table access and the shared folder that lineage is cut in."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, GroupedData, SparkSession


ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, also in a session that was started elsewhere."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only on a single machine may it be unset:
    then a temporary one is made."""
    importable(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weirflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables in the shared folder, in the order in which they were written.
_tables: list[str] = []

#: Else shuffle files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder. The shuffle files of the step go once it is written."""
    path, conf = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    _tables.append(path)
    return df.sparkSession.read.parquet(path)


def made() -> int:
    """The number of tables written so far, for ``finished``."""
    return len(_tables)


def finished(df: DataFrame, since: int) -> DataFrame:
    """``df`` written; the tables that were written for it, all from number ``since`` on, are deleted."""
    out, spark = written(df), df.sparkSession
    for path in _tables[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:-1]
    return out


def width(spark: SparkSession) -> int:
    importable(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _murmur(i: np.ndarray) -> np.ndarray:
    """Spark's hash() of ints."""
    u = np.uint32
    k = i.astype(u) * u(0xCC9E2D51)
    k = (k << u(15) | k >> u(17)) * u(0x1B873593)
    h = u(42) ^ k
    h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64) ^ u(4)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32)


def spread_keys(n: int) -> list[int]:
    """n ints of which hash partitioning puts one in each of n partitions. Plain 0..n-1 collide: some partitions would
    get several large groups and others none."""
    found, begin = np.full(n, -1), 0
    while (found < 0).any():
        i = np.arange(begin, begin + 4 * n + 64)
        at, first = np.unique(_murmur(i) % n, return_index=True)
        new = found[at] < 0
        found[at[new]] = i[first[new]]
        begin += len(i)
    return found.tolist()


def by_bucket(df: DataFrame, n: int) -> GroupedData:
    """Groups of ``bucket``, n keys of ``spread_keys``, each a partition of its own."""
    return df.repartition(n, "bucket").groupBy("bucket")
