"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Has Spark (4.1) drop the shuffle files of a write when it ends, not when the driver's collector happens to run.
NO_SHUFFLES_LEFT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session whose tasks all run in the driver's own process may lack it: that gets a
    folder of its own; on a cluster a folder that executors cannot see would lose rows, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="depquarry-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back, so that a lost executor costs no
    recomputation of what came before. Files are laid out ``by`` a column, so that a filter on it reads its own only."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind."""
    before = {k: spark.conf.get(k, "false") for k in NO_SHUFFLES_LEFT}
    try:
        for k, v in NO_SHUFFLES_LEFT.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, as small as it gets on disk: packed tighter, and its shuffle files go with the write."""
    path = scratch_path(df.sparkSession, name)
    with no_shuffles_left(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` or ``settled`` returned, as soon as all that reads them is written itself."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            remove(df.sparkSession, path)
