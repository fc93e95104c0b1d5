"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries to Python. Texts may be long, and a worker holds a batch whole.
BATCH_ROWS = 256


#: A key of fewer rows is never hot; of a table, HOT_KEYS keys at most have more than 1/HOT_KEYS of its rows.
HOT_ROWS, HOT_KEYS = 100_000, 1000

_OWN: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='panelspark-')}"
    return _OWN[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    return posixpath.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path that goes with the inner tables of ``scratch``."""
    path = fresh_path(spark, what)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what ``written`` made inside, but for paths given to the function it yields; what that one keeps, an outer one may remove."""
    keep: list[str] = []
    _SCRATCH.append([])
    try:
        yield keep.append
    finally:
        for path in set(_SCRATCH.pop()) - set(keep):
            remove(spark, path)
        if _SCRATCH:
            _SCRATCH[-1].extend(keep)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has each key once and, in ``n``, how many rows have it; ``n`` is dropped.

    No task gets all rows of a hot key: keys with more than 1/HOT_KEYS of the ``total`` rows, HOT_KEYS of them at most, are
    broadcast, and their rows stay where they are. The others are shuffled.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    if total <= least:
        return rows.join(per_key.drop(n), key)
    hot = per_key.filter(F.col(n) > least)
    apart = rows.join(F.broadcast(hot.drop(n)), key)
    return apart.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(F.col(n) <= least).drop(n), key))


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for batches of the longest texts: lowers the session's setting, which must hold when rows are worked out."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file that tasks write or read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, attempt: str):
    """Context manager: a stream whose file appears under its name only once it is complete.

    A task that runs again after a lost executor writes the file anew under the same name.
    """
    @contextlib.contextmanager
    def opened():
        at, path = file_system(uri)
        with at.open_output_stream(f"{path}.{attempt}.part") as stream:
            yield stream
        at.move(f"{path}.{attempt}.part", path)

    return opened()


def make_dir(uri: str) -> str:
    at, path = file_system(uri)
    at.create_dir(path, recursive=True)
    return uri


def one_by_one(rows: DataFrame, key: str) -> DataFrame:
    """A small table of work items, dealt so that each task gets one or a few."""
    n = rows.count()
    return rows.repartitionByRange(max(1, n), key)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table, as literals in the plan."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


def list_files(folder: str) -> list[tuple[str, int]]:
    """(URI, size) of the files in a folder of the shared one: what a job wrote, so as many as its tasks."""
    from pyarrow import fs

    at, path = file_system(folder)
    found = at.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f"{folder.rstrip('/')}{x.path.removeprefix(path.rstrip('/'))}", x.size) for x in found if x.is_file)


def path_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row (file, path) for each path, numbered from 0."""
    return spark.createDataFrame(list(enumerate(paths)), "file int, path string")
