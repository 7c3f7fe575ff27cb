"""Intermediate tables in the cluster's shared folder.

Long jobs cut their lineage here: a stage is written as Parquet and read
back, so a lost executor costs the tasks it was running and nothing before.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


#: Static estimates follow compressed file sizes, so only tables far below Spark's 10 MB are broadcast by them (bytes).
ESTIMATED = 256 << 10
#: Shuffled rows are compressed too and go through the driver once a join, so tables of more than this are not broadcast even where the session allows it (bytes).
SENT = 1 << 20
STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_GIVEN = "millrace.autoBroadcastJoinThreshold"


def joins_by_measured_size(spark: SparkSession) -> None:
    """Broadcast what measures small once it is shuffled, not what its files make look small.

    A Parquet table of keys and few values takes a few bytes a row and its hash
    table a hundred times that, built on the driver. Measured sizes are trusted
    up to ``SENT``, estimates up to ``ESTIMATED``, and neither beyond what the
    session allows. ``joins_as_given`` puts the settings back.
    """
    if spark.conf.get(_GIVEN, None) is not None:
        return
    given = spark.conf.get(STATIC)
    spark.conf.set(_GIVEN, f"{given} {spark.conf.get(MEASURED, None) or ''}")
    measured = spark.conf.get(MEASURED, None) or given
    spark.conf.set(MEASURED, str(min(SENT, _bytes(measured))))
    spark.conf.set(STATIC, str(min(ESTIMATED, _bytes(given))))


def _bytes(size: str) -> int:
    """A setting such as 10MB, 10485760b or -1 in bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0)


def joins_as_given(spark: SparkSession) -> None:
    kept = spark.conf.get(_GIVEN, None)
    if kept is None:
        return
    given, measured = kept.split(" ")
    spark.conf.set(STATIC, given)
    spark.conf.set(MEASURED, measured) if measured else spark.conf.unset(MEASURED)
    spark.conf.unset(_GIVEN)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-millrace-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/millrace-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_path`` named, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
