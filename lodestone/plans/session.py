"""The Spark session and what executors need of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's semantics need: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, so their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(ship_package, "sent", None) == sc.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="lodestone-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    ship_package.sent = sc.applicationId


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a session on one machine may do without that setting. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
