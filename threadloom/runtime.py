"""What operators need from the session: scratch tables, worker import path, table reading."""

from __future__ import annotations

import atexit
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Lets Python workers of this session import this package, wherever it was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Arbitrary keyed state needs this state store; it holds keys on disk, so state may be larger than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a batch uses the store too, but only the manager of streams starts what its tasks report to
    _ = spark.streams.active


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_threadloom_scratch"
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, on any file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator run, written as Parquet to the shared folder so that lost executors cost a reread only."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written under ``name`` and read back; its lineage ends here."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        # nothing needs this plan's shuffle files any more: they go when the driver's JVM drops its references
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        delete(self.spark, f"{self.path}/{name}")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
