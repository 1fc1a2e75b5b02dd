"""Session helpers: shipping this package to executors and the shared work folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per Spark context.

    Python workers import functions by module name. The zip is served by the driver, so
    nothing depends on a folder that driver and executors share.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows are whole texts
    sc = spark.sparkContext
    if not getattr(sc, "_cipherlode_shipped", False):
        path = os.path.join(tempfile.mkdtemp(), f"cipherlode-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
        sc.addPyFile(path)
        sc._cipherlode_shipped = True
    return spark


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where that is unset, an own folder in local mode; on a cluster an error, as executors would
    each write to their own disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_cipherlode_work", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cipherlode-')}"
        sc._cipherlode_work = base
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder from any file system that Spark knows."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may have gone by then
        pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; where there is none, make an empty one."""
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = names(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(names(path)):
        fs.mkdirs(names(to))
    elif not fs.rename(names(path), names(to)):
        raise OSError(f"{path} could not be renamed to {to}")


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored makes inside are removed at the end, but for those given to what this yields.

    For work that is finished by then: whatever reads such a table lazily afterwards finds it gone.
    """
    made: list[str] = []
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made[:] = [path for path in made if path != df._cipherlode_path]
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            remove(spark, path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the work folder; what is there is removed when Python ends."""
    path = f"{work_folder(spark)}/cipherlode-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    if _open:
        _open[-1].append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation. The table is removed when
    Python ends, or before by discard or scratch.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cipherlode_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that stored gave, once nothing reads it any more."""
    path = getattr(df, "_cipherlode_path", None)
    if path:
        remove(df.sparkSession, path)
