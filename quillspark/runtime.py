"""Session-level helpers: table access, the shared scratch folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []
_STAGED: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()

#: Groups holding more than this share of the rows are "hot"; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    folder = f"{scratch_dir(spark)}/quillspark/lib-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{here.name}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    _STAGED.append((spark, folder))
    context.addPyFile(f"{folder}/{here.name}.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="quillspark-"))
    return "file://" + _LOCAL[0].name


def scratch_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. The table is removed when the
    driver ends, because lazily evaluated results may still read it until then.
    """
    spark = df.sparkSession
    path = scratch_file(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(staged: DataFrame) -> None:
    """Remove a table written by ``stage`` that nothing reads any more."""
    _delete(staged.sparkSession, staged._staged_at)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            break


def hot_values(df: DataFrame, column: str, share: float = HOT_SHARE) -> list:
    """The values of a column that hold more than ``share`` of all rows (at most ``1 / share``), by a mergeable sketch in one pass.

    The sketch's error is a fraction of ``share``, so a value just below it may be among them.
    """
    most = int(1 / share)
    row = df.select(F.count("*").alias("n"), F.expr(f"approx_top_k({column}, {most}, {20 * most})").alias("top")).first()
    return [x["item"] for x in row.top or [] if x["count"] > share * row.n and x["item"] is not None]


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-group ``groups`` that does not suffer from hot groups.

    Groups with more than ``HOT_SHARE`` of all ``total`` rows go out by broadcast: there are at most
    ``1 / HOT_SHARE`` of them whatever the data. All others meet their rows by a shuffle in which no
    key holds more than that share. Rows with a null in a key have no group.
    """
    most = max(1, int(total * HOT_SHARE))
    hot, cold = groups.where(F.col(size) > most), groups.where(F.col(size) <= most)
    kept = [c for c in groups.columns if c not in keys]
    by_broadcast = rows.join(F.broadcast(hot), keys, "inner")
    by_shuffle = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    return by_broadcast.select(*rows.columns, *kept).unionByName(by_shuffle.select(*rows.columns, *kept))


def first_value(df: DataFrame, column: Column) -> object:
    """One aggregated value, brought to the driver."""
    return df.agg(column).first()[0]
