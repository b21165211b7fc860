"""One place that decides how a Spark session is configured."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: The most that an Arrow batch to Python should hold. Texts are long; batches of the default size fill an executor's direct memory.
ARROW_BATCH_BYTES = 4 << 20


def with_code(df: DataFrame) -> DataFrame:
    """The frame itself, once its executors can import this package, wherever they run, and get batches of bounded size."""
    sc = df.sparkSession.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get(size))
    if not 0 < now <= ARROW_BATCH_BYTES:
        df.sparkSession.conf.set(size, str(ARROW_BATCH_BYTES))
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="driftcurve-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/driftcurve_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(path)
    return df


def local_session(cores: int | str | None = None, app: str = "driftcurve", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that the platform gives."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DRIFTCURVE_DRIVER_MEMORY", "8g"),
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
