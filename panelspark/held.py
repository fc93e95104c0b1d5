"""Tables that operators read more than once are written to the shared folder; ``release`` removes them when results are no longer needed."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HELD: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='panelspark-')}")


def hold(df: DataFrame) -> DataFrame:
    """``df``, written and read again: its plan ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = posixpath.join(shared_dir(spark), f"held-{uuid.uuid4().hex}")
    _HELD.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove all that operators hold. What they returned can't be worked out any more."""
    while _HELD:
        spark, path = _HELD.pop()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
