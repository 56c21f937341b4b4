"""Session settings for local use and tests; on a cluster the session is given."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from .durable import shared_root, write_bytes


def local_session(cores: int | None = None, app: str = "grovelake", memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries expect (UTC, adaptive execution, few shuffle partitions)."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()
_files: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through the shared folder, so that functions run in Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(here)
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    out.write(path, os.path.relpath(path, root))
    target = f"{shared_root(spark)}/grovelake/ship-{uuid.uuid4().hex}/{name}.zip"
    write_bytes(spark, target, archive.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Give the executors a file of the driver's machine through the shared folder, once per application; its name for ``SparkFiles.get``."""
    key = (spark.sparkContext.applicationId, os.path.abspath(path))
    if key not in _files:
        name = f"{uuid.uuid4().hex}-{os.path.basename(path)}"
        with open(path, "rb") as f:
            target = f"{shared_root(spark)}/grovelake/ship-{uuid.uuid4().hex}/{name}"
            write_bytes(spark, target, f.read())
        spark.sparkContext.addFile(target)
        _files[key] = name
    return _files[key]
