"""Session settings the jobs were tuned with; a cluster may set its own."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Skewed joins are split and small shuffles merged at run time; broadcasts stay size-checked.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing makes long generated methods, which the JVM never compiles past 8000 bytes; beyond that
    # Spark's per-operator code is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A JSON object that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, app: str = "tallyloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that Python code of tasks can import it wherever it runs."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(home)
    # Executors fetch it from the driver, in whose folder it stays until Spark ends.
    archive = os.path.join(tempfile.mkdtemp(prefix=name, dir=context._temp_dir), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for place, _, files in os.walk(home):
            for file in sorted(files):
                if file.endswith(".py"):
                    full = os.path.join(place, file)
                    packed.write(full, os.path.join(name, os.path.relpath(full, home)))
    context.addPyFile(archive)
    context._tallyloom_shipped = True
