"""Writers. All go through Spark's commit protocol, so a reader never sees half a result."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint, shared_dir


def canonical_json(value) -> str:
    """Sorted keys, no spaces, NFC, finite numbers only."""

    def clean(x):
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            return {clean(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_new(df: DataFrame, path: str) -> None:
    """Parquet; an existing target is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Exactly these fields; floats in full precision, booleans in lower case."""
    df.select(*fields).write.option("header", True).csv(path)


def write_parts(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables below one folder, written to a staging folder and renamed at the end."""
    spark = SparkSession.active()
    staging = f"{path.rstrip('/')}._staging"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(source, True)
        raise FileExistsError(path)
    if not fs.rename(source, target):
        raise OSError(f"could not publish {path}")


def split_failures(outcomes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, failures): rows without and with a reason_code; failures sorted within their files."""
    failed = outcomes.where("reason_code is not null").select(key, "reason_code")
    return outcomes.where("reason_code is null").drop("reason_code"), failed.sortWithinPartitions(key)


def scratch(spark: SparkSession) -> str:
    """A new folder in the store that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives of what ``write`` wrote; the files are gone afterwards."""
    path = scratch(spark)
    write(path)
    out = checkpoint(read(path))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out
