"""The folder that driver and executors share: intermediate tables in it cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_RUN = uuid.uuid4().hex


def _checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder set as ``spark.checkpoint.dir`` or by ``SparkContext.setCheckpointDir``."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        there = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return there.rstrip("/") if there else None


def shared_dir(spark: SparkSession) -> str:
    """This process's folder within the one that driver and executors share; deleted when the process ends.

    Only where no such folder is set and the master is local, as in tests, a temporary folder of this machine stands in.
    """
    there = _checkpoint_dir(spark)
    key = there or spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        master = spark.sparkContext.master
        if not there and master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        _OWN_DIRS[key] = f"{there}/quernstone-{_RUN}" if there else "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _OWN_DIRS[key]


@atexit.register
def _clean() -> None:
    gateway = SparkContext._gateway
    for path in _OWN_DIRS.values() if gateway else ():
        try:
            p = gateway.jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM has gone before: the folder stays
            return


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Deletes, at the end of a ``with`` block, the tables that ``written`` made in it (in this thread), but for those given to ``keep``."""

    _open = threading.local()

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        Scratch._open.stack = [*getattr(Scratch._open, "stack", ()), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Not to be deleted here, but by the block around this one, if there is one."""
        self.tables = [x for x in self.tables if x is not df]
        for outer in Scratch._open.stack[:-1][-1:]:
            outer.tables.append(df)
        return df

    def __exit__(self, *_) -> None:
        Scratch._open.stack = Scratch._open.stack[:-1]
        for x in self.tables:
            drop_written(x)


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    for scratch in getattr(Scratch._open, "stack", ())[-1:]:
        scratch.tables.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
