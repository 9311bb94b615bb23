"""Sessions and what executors need: threads of a task, the package itself."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# The variables by which numeric libraries take their number of threads.
THREAD_VARIABLES = ("OMP_NUM_THREADS", "MKL_NUM_THREADS", "OPENBLAS_NUM_THREADS")


def executor_settings(threads: int = 1) -> dict[str, str]:
    """Settings under which a task has ``threads`` threads: its libraries may use no more, and the scheduler keeps
    as many cores for it."""
    if threads < 1:
        raise ValueError("a task has at least one thread")
    env = {f"spark.executorEnv.{v}": str(threads) for v in THREAD_VARIABLES}
    return env | {"spark.task.cpus": str(threads), "spark.sql.session.timeZone": "UTC"}


def open_session(master: str | None = None, threads: int = 1, name: str = "earshot") -> SparkSession:
    """A session with these settings; one on another master ends first."""
    old = SparkSession.getActiveSession()
    if old is not None and master and old.sparkContext.master != master:
        old.stop()
    if master is None or master.startswith("local"):
        for v in THREAD_VARIABLES:  # workers of a local master inherit the driver's
            os.environ[v] = str(threads)
    builder = SparkSession.builder.appName(name).config(map=executor_settings(threads))
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def package_zip(folder: str | None = None) -> str:
    """The package's source files in one zip file, without caches."""
    top = Path(__file__).resolve().parents[1]
    out = Path(folder or tempfile.mkdtemp(prefix="earshot-")) / "earshot.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    return str(out)


def needs_shipping(master: str) -> bool:
    """Workers of a local master share the driver's files; ``local-cluster`` has workers of its own."""
    return not (master == "local" or master.startswith("local["))


def ship(spark: SparkSession) -> str | None:
    """Sends the package to executors that don't share the driver's files; returns the file."""
    if not needs_shipping(spark.sparkContext.master):
        return None
    file = package_zip()
    spark.sparkContext.addPyFile(file)
    return file
