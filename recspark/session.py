"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cores = str(cpus)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recspark")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    `spark.checkpoint.dir` (or a checkpoint directory already set) wins. Only a
    local session without either gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="recspark-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_scopes: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, or below that of the innermost `scratch`."""
    return f"{_scopes[-1] if _scopes else shared_dir(spark)}/recspark-{uuid.uuid4().hex}/{name}"


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a path that `work_path` gave."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are written inside are removed at the end; results must have been written elsewhere by then."""
    folder = work_path(spark, "scratch")
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        _remove(spark, folder)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a table that is written inside go as soon as it is there, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to `path` and read from there; their shuffle files are removed."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def written_parts(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """The rows of all parts, which are made and written one after the other; the shuffle files of each go before the next one begins."""
    rows = [written(df, f"{path}/{i}") for i, df in enumerate(parts)]
    spark = rows[0].sparkSession
    return spark.read.schema(rows[0].schema).parquet(*[f"{path}/{i}" for i in range(len(rows))])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them from there.

    Lost executors recompute nothing, and later row counts come from the Parquet footers.
    """
    return written(df, work_path(df.sparkSession, "table"))


def checkpointed_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that `make` gives, as `checkpointed`; the tables that it writes on the way are removed."""
    path = work_path(spark, "table")
    with scratch(spark):
        return written(make(), path)


class Latest:
    """The tables of an iteration: a new table of a name takes the place of the one before, once it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, rows: DataFrame | Iterable[DataFrame]) -> DataFrame:
        path = work_path(self.spark, name)
        rows = written(rows, path) if isinstance(rows, DataFrame) else written_parts(rows, path)
        self.remove(name)
        self.paths[name] = path
        return rows

    def remove(self, *names: str) -> None:
        for name in names or list(self.paths):
            path = self.paths.pop(name, None)
            if path is not None:
                _remove(self.spark, path)


def spread(table: DataFrame, *by: str, below: int = 256 * 1024 * 1024, above: int = 4 * 1024 * 1024) -> DataFrame:
    """Spread a small table that lies in fewer splits than there are cores, such as a file of one row group.

    Only for plain scans. Larger tables and tables in enough splits pass unchanged: they need no shuffle.
    """
    execution = table._jdf.queryExecution()
    size = int(execution.optimizedPlan().stats().sizeInBytes())
    if not above <= size < below or execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, *by)
