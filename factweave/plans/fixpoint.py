"""The driver of relational fixpoints: semi-naive rounds over a delta.

Each round joins only what the last one found, removes what is known with an
anti-join and writes the delta as a table below ``spark.checkpoint.dir``; a
lost executor costs a re-read.  Every ``COMPACT`` rounds the deltas become one
table, so plans and file lists stay short; tables that nothing reads any more
are deleted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Deltas that are read side by side before they are written as one table.
COMPACT = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a local one only where there are no other machines (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_factweave_dir", None) or "file://" + tempfile.mkdtemp(prefix="factweave-")
        spark.sparkContext._factweave_dir = named
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fixpoint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fixpoint_path = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._fixpoint_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """The least set that holds ``start`` and, with any rows, what ``step`` makes of them; all columns are the key."""
    known = delta = written(start.distinct())
    held = [known]
    for _ in range(max_rounds):
        delta = written(step(delta).select(*start.columns).distinct().join(known, start.columns, "left_anti"))
        if delta.isEmpty():
            return known
        held.append(delta)
        known = known.union(delta)
        if len(held) > COMPACT:
            known = written(known)
            deleted(*held[:-1])
            held = [known]
    raise RuntimeError("no fixpoint within the allowed rounds")


def least(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, max_rounds: int = 10_000) -> DataFrame:
    """The least ``value`` of each key under ``step``: only improved rows go on to the next round."""
    from pyspark.sql import functions as F

    known = delta = written(start.groupBy(*keys).agg(F.min(value).alias(value)))
    for _ in range(max_rounds):
        found = step(delta).groupBy(*keys).agg(F.min(value).alias(value))
        old = known.select(*keys, F.col(value).alias("_old"))
        before, last = known, delta
        delta = written(found.join(old, keys, "left").where(F.col("_old").isNull() | (F.col(value) < F.col("_old"))).select(*keys, value))
        if delta.isEmpty():
            return known
        known = written(known.union(delta).groupBy(*keys).agg(F.min(value).alias(value)))
        deleted(before, *([last] if last is not before else []))
    raise RuntimeError("no fixpoint within the allowed rounds")
