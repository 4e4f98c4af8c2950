"""Sessions and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Fixed settings that results rely on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "tillwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with REQUIRED set. ``master`` is for tests and benches only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (REQUIRED | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a plain local master gets
    a temporary folder (one machine, so it is shared), anything else a folder in the warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        global _own
        if _own is None or not os.path.isdir(_own):
            _own = tempfile.mkdtemp(prefix="tillwright-")
        return f"file://{_own}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


#: Bytes of a table file for each shuffle partition: tokens laid out from a table are many times its size.
PARTITION_BYTES = 2 << 20
#: Bytes of a shuffle that adaptive execution may join in one task, at most: a receipt's row of few bytes is laid out in
#: many tokens, so that the 64 MB it takes by default become some GB in a sort, and are spilled.
JOINED_BYTES = 1 << 20
_bytes: dict[tuple[str, str], int] = {}


def scale_partitions(spark: SparkSession, folder: str, name: str) -> None:
    """Let shuffles begin with partitions in step with the tables read from ``folder``, so that a task's share
    does not grow with the input; adaptive execution joins those that turn out small, up to JOINED_BYTES."""
    if (folder, name) not in _bytes:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        _bytes[folder, name] = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    most = max(n for (f, _), n in _bytes.items() if f == folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(int(spark.conf.get("spark.sql.shuffle.partitions")), most // PARTITION_BYTES))
    joined = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{min(joined, JOINED_BYTES)}b")


def partitions(spark: SparkSession) -> int:
    """How many partitions shuffles begin with, for rows that are dealt before they are laid out in many more."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


_own: str | None = None
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read of files and not the work before them. ``release`` deletes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialize`` has written and ``release`` not deleted: a mark for ``since``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables written by ``materialize`` after the mark ``since``, but the last ``keep`` ones;
    results that read them must have been consumed. Returns how many were deleted."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = max(since, len(_written) - keep)
    gone, _written[since:end] = _written[since:end], []
    n = 0
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
