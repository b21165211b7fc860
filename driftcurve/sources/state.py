"""Tables of an iterative job's state, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset, in local mode only: a cluster's machines do not share their own folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='driftcurve-')}"
    return root.rstrip("/")


class Store:
    """Named Parquet tables under the session's shared folder.

    A table written under a name twice gets a new place each time, so that plans which read the old one
    stay valid. All goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.tables: list[str] = []
        atexit.register(self._close)

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write and read back; with `by` in a folder for each value of that column."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table in `buckets` files' groups by a key's hash, sorted by it: joins on the key read it in place, without a shuffle of it."""
        path, table = f"{self.root}/{name}", f"{name}_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, name: str) -> None:
        """Delete the table that was written last under a name."""
        if name in self.paths:
            self._delete(self.paths.pop(name))

    def drop_all(self) -> None:
        self._delete(self.root)

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for t in self.tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {t}")
                self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone already when the interpreter ends
            pass
