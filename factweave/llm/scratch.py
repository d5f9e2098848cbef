"""Tables written to the shared checkpoint folder.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``: every
executor can read them, so a lost executor costs a re-read and not a re-run,
and unlike RDD checkpoints they are columnar and compressed.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; where none is set, a local one if there are no other machines (tests), else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(spark.sparkContext, "_scratch_dir", None)
    if held is None:
        held = "file://" + tempfile.mkdtemp(prefix="factweave-")
        spark.sparkContext._scratch_dir = held
        atexit.register(_remove_local, held)
    return held


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Documents in an Arrow batch; with the session's ten thousand, batches of long texts take hundreds of MB twice.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, if it is larger, to what workers with little memory can hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Named intermediate tables of one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads what was written."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        # Numbers here are mostly hashes: compressing them saves little, and every writer's buffers lie outside the heap.
        text = any(kind in ("string", "binary") or "<" in kind for _, kind in df.dtypes)
        df.write.mode("overwrite").option("compression", "zstd" if text else "uncompressed").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets go of the shuffle files of finished queries, which Spark keeps until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which what is returned still reads."""
        self.drop(*(self.names - set(names)))


def partitions(spark: SparkSession) -> int:
    bound_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
