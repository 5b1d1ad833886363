"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; it then gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), f"tessella-{os.getpid()}")
    os.makedirs(at, exist_ok=True)
    return "file://" + at


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so nothing upstream is computed again by the branches
    that follow, and survives the loss of executors. The table goes with the
    ``scratch`` block around it, else when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _delete_on_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


_OWNED = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within the block, in this thread, are removed at its end; results must have been read or saved by then."""
    before = getattr(_OWNED, "paths", None)
    _OWNED.paths = []
    try:
        yield
    finally:
        mine, _OWNED.paths = _OWNED.paths, before
        for at in mine:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete_on_exit(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    if getattr(_OWNED, "paths", None) is not None:
        _OWNED.paths.append(at)


def cut_buckets(df: DataFrame, keys: list[str], order: list[str], name: str = "stage", partitioned: bool = False) -> DataFrame:
    """As ``cut``, hashed into buckets by ``keys`` and sorted in them: windows and joins by these keys read it without a shuffle.

    ``partitioned`` says that the plan's last exchange is one by ``keys`` already, as before a window by them.

    The table is external and known to the session's catalog for as long as the session lasts.
    """
    spark = df.sparkSession
    n = partitions(spark)
    table = f"tessella_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{table}-{name}"
    (df if partitioned else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*order).option("path", at).saveAsTable(table)
    _delete_on_exit(spark, at)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
