"""Session settings, and shipping this package to Python workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a local session is built with; a cluster sets its own master and sizes.
LOCAL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("speechlake").config("spark.driver.memory", memory)
    spark = builder.config(map=LOCAL | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Give the package to Python workers, which need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="speechlake-code-")) / "speechlake-code.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir); where that is unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="speechlake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/speechlake-{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor loses none of it, and Spark's cleaner may drop it with the last reference."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(path) if path else work_folder(spark, "checkpoints")
    return df.checkpoint()
