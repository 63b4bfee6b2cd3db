"""Session helpers: one place that builds a SparkSession and resolves the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (a small side becomes a broadcast only
# once its measured size is under the threshold) and splits skewed shuffle partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Streaming state (one row per run, open spans per run) lives in RocksDB on local disk, not the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "runscope", shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it to a shared filesystem: without it, each executor would write to its
    own disk, so that is an error. Only a local session without the setting gets a scratch folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="runscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for intermediate tables and stream state."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.getpid()}-{next(_counter)}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: what made it runs once, and a lost executor costs a
    re-read of the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SharedFolder:
    """Folders of the shared store that appear all at once: written aside, then moved to their name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names in the folder, but for those that readers pass over."""
        if not self._fs.exists(self._path("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
                      if not n.startswith(("_", ".")))

    def publish(self, name: str, write) -> bool:
        """``write(path)`` the folder ``name``, unless it is there already: what stands under a name never changes, so a
        step that is run again after a crash changes nothing. A crash before the move leaves nothing to read."""
        if self._fs.exists(self._path(name)):
            return False
        aside = f"_aside-{uuid.uuid4().hex}"
        write(f"{self.path}/{aside}")
        self.move(aside, name)
        return True

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.path}/{old} could not be moved to {new}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
