"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows of a batch that goes to Python: texts and pictures are large rows. Sessions that state a number of their own keep it.
BATCH, BATCH_ROWS, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"
_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def local_session(cores: int = 8, partitions: int = 8, name: str = "ocellus", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share, removed when the driver ends. On one machine any folder will do."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(shared or tempfile.gettempdir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once a context: nothing has to be installed on them."""
    context = spark.sparkContext
    if context not in _shipped:
        folder = Path(tempfile.mkdtemp(prefix="ocellus-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).resolve().parent
        with zipfile.ZipFile(folder / "ocellus.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(folder / "ocellus.zip"))
        _shipped[context] = True
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark
