"""Tables in versions: a new state is written aside and counts once its last file, the mark, is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Tables under a folder that driver and executors share, one folder per version. A version whose writing
    was broken off has no mark and is never read; of two writers of one version only one can set the mark."""

    MARK = "_COMPLETE"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest complete version, 0 without one."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n) for n in found if n.isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/{self.MARK}"))), default=0)

    def read(self) -> dict[str, DataFrame]:
        """The tables of the newest complete version."""
        top = f"{self.root}/{self.version()}"
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(top))]
        return {n: self.spark.read.parquet(f"{top}/{n}") for n in names if n != self.MARK}

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version and return it. What a broken attempt left is written over."""
        n = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{n}/{name}")
        self._fs.create(self._path(f"{self.root}/{n}/{self.MARK}"), False).close()
        return n
