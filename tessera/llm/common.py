"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    """What this driver wrote and nobody has removed goes when it ends."""
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Only where a session on one machine has no such setting (tests, a laptop) is a local folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._tessera_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that nothing will read again."""
    folder = getattr(df, "_tessera_folder", None)
    if folder:
        _remove(df.sparkSession, folder)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != folder]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if PYTHONPATH doesn't name it."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._tessera_shipped = True


def slices(batch, column: int, chars: int):
    """The rows of an Arrow batch in runs of about so many bytes of a text column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at, n = 0, batch.num_rows
    while at < n:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(sizes.searchsorted(before + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_CACHES: dict[str, Callable[[], object]] = {}


def claim(name: str, clear: Callable[[], object]) -> None:
    """To be called in a Python worker by the operator that runs there: what other operators keep in it goes."""
    for other, drop in _CACHES.items():
        if other != name:
            drop()
    _CACHES.clear()
    _CACHES[name] = clear
