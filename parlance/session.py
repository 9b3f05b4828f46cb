"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master, where driver and executors are one process, may fall back to a temporary folder; a
    cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="parlance-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_SCOPES: list[list[Stage]] = []


class Stage:
    """A written intermediate table: read through ``df``, removed with ``drop`` once nothing reads it any more.

    All stages of an application lie in one folder under the shared one (see :func:`forget`).
    """

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/parlance-{spark.sparkContext.applicationId}"


@contextmanager
def stages() -> Iterator[None]:
    """Removes at its end all stages written inside: for work whose result has been written or read by then.

    A query's result is lazy and reads its stages when it is used, so the use belongs inside.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for stage in _SCOPES.pop():
            stage.drop()


def forget(spark: SparkSession) -> None:
    """Removes all stages of this application; no earlier result can be read any more."""
    _delete(spark, _own_folder(spark))


def written(spark: SparkSession, folder: str) -> bool:
    """Whether a table has been written to a folder and completed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back: no recomputation, and safe against executor loss."""
    return Stage(df, label).df


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package; nothing to do where PYTHONPATH already has it."""
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_parlance", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    path = f"{_own_folder(spark)}-{uuid.uuid4().hex}/{root.name}.zip"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    context.addPyFile(path)
    context._parlance = True
