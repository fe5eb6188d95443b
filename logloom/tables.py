"""Where the shared Parquet tables are, and how intermediate tables are kept."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only for local mode, where driver and executors are one machine.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Rows of an Arrow batch at most, so that neither a Python worker nor the JVM beside it holds tens of MB of texts at once.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in `sf_dir`, any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; an own one only in local mode, where that may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def _tables(spark: SparkSession) -> str:
    """This application's folder of tables, deleted when the application ends."""
    sc = spark.sparkContext
    root = f"{checkpoint_dir(spark)}/tables/{sc.applicationId}"
    if root not in getattr(sc, "_logloom_tables", ()):
        p = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._logloom_tables = (*getattr(sc, "_logloom_tables", ()), root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back.

    The lineage ends there, so the loss of an executor costs nothing that was
    computed before, and a result that is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _blocks():
        _blocks()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_local = threading.local()


def _blocks() -> list[list[str]]:
    """The open scratch blocks of this thread, innermost last."""
    if not hasattr(_local, "blocks"):
        _local.blocks = []
    return _local.blocks


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes inside are deleted at the end, but for those given to the yielded function.

    What leaves the block must be such a table, or read none of the others.
    """
    mine: list[str] = []
    _blocks().append(mine)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.append(mine.pop())
        return out

    try:
        yield keep
    finally:
        _blocks().pop()
        if _blocks():
            _blocks()[-1].extend(kept)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files behind frames that materialize() returned and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = f"{_tables(spark)}/".split(":", 1)[-1]
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in path:
                _delete(spark, path)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task; when the task ends, the worker gives the memory it freed back to the system."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def ship(spark: SparkSession) -> None:
    """Give this package to all Python workers, once for each Spark context, and bound the batches they get."""
    sc = spark.sparkContext
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if getattr(sc, "_logloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='logloom-')}/logloom.zip"  # the driver serves it to the executors as long as it lives
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"logloom/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._logloom_shipped = True
