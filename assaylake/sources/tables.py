"""Tables of a data folder."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Smaller files than this are not worth a shuffle.
LEAST_BYTES = 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than the cluster has cores, as of a file that cannot be split, dealt over the cores; any other as it is."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) < LEAST_BYTES or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over so many tasks that each has about ``rows`` rows at most, for work whose memory grows with the rows of a task;
    a table of no more rows than that for each core is left as it is."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


#: Folders, and tables by name, written in each open ``scratch``, the innermost last; the first are removed when the driver ends.
_OPEN: list[list[tuple[str, str | None]]] = [[]]


def _beside_warehouse(master: str, warehouse: str) -> str:
    """A folder beside the warehouse's tables, unless that is a local one of a session whose executors may be elsewhere."""
    if not master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("executors may not see the folder of spark.sql.warehouse.dir: set spark.checkpoint.dir to one that all share")
    return f"{warehouse.rstrip('/')}/_shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one beside the warehouse's tables where it is unset;
    a local warehouse serves only local sessions."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(own or _beside_warehouse(context.master, spark.conf.get("spark.sql.warehouse.dir")))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str, is_table: bool = False) -> str:
    """A path in the shared folder that is removed with what is stashed."""
    path = f"{shared_dir(spark)}/{name}"
    _OPEN[-1].append((path, name if is_table else None))
    return path


def lasting_path(spark: SparkSession, name: str) -> tuple[str, bool]:
    """A path in the shared folder that stays until the driver ends, whatever ``scratch`` is open, and whether something is there."""
    path = f"{shared_dir(spark)}/{name}"
    if (path, None) not in _OPEN[0]:
        _OPEN[0].append((path, None))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def version(spark: SparkSession, path: str) -> str:
    """A digest of a file's or folder's path, and the sizes and times of its files: another one after any change."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.md5("\n".join([path, *told]).encode()).hexdigest()


def _remove(written: list[tuple[str, str | None]]) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or SparkContext._active_spark_context is None:
        return
    for path, name in written:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_rest() -> None:
    try:
        _remove([entry for level in _OPEN for entry in level])
    except Exception:  # noqa: BLE001  the session may be gone; what is left then goes with the shared folder
        pass


@contextmanager
def scratch() -> Iterator[None]:
    """What is stashed inside is removed at the end; a result that is to stay is written outside."""
    _OPEN.append([])
    try:
        yield
    finally:
        _remove(_OPEN.pop())


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so a lost executor costs no more
    than its running tasks.

    :param by: columns of few values, each of which gets files of its own; a filter on them reads only these.
    """
    path = shared_path(df.sparkSession, f"stash-{uuid.uuid4().hex}")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``column``: a join on it does not move the table."""
    name = f"assaylake_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", shared_path(df.sparkSession, name, True)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
