"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package as a zip, once for each application; nothing has to be installed there.

    Rows may hold long texts, so Arrow batches are also cut at BATCH_BYTES, unless the session sets a size of its own.
    """
    if spark.conf.get(BATCH_KEY) == "67108864b":
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if any(a == app for a, _ in _SHIPPED):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    name = f"glossa-{hashlib.sha256(held.getvalue()).hexdigest()[:12]}.zip"
    path = Path(tempfile.mkdtemp(prefix="glossa-")) / name
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add((app, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a local folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="glossa-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: what follows starts from files, not from its lineage."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("glossa")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
