"""Session defaults and the shared working folder for staged results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "barlake", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by the cluster; where none is named, `fallback` or a folder in the warehouse.

    All of them are reached by every executor; no machine-local folder is used.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if fallback:
        return fallback.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"


def write_stage(df: DataFrame, folder: str, label: str) -> str:
    """Write `df` once as Parquet under `folder` and return its path."""
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, folder: str, label: str) -> DataFrame:
    """Write `df` once as Parquet under `folder` and read it back.

    Cuts the lineage so that later steps neither parse the input again nor lose it with an executor, and gives the
    optimizer the true size of the result for its join choice.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, folder, label))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame without rows that the optimizer knows to be empty, so that joins with it vanish from the plan."""
    fields = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT {fields} WHERE false")


def together(*steps: Callable[[], object]) -> list:
    """The results of steps that don't need each other; their Spark jobs run at the same time."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [found.result() for found in [pool.submit(step) for step in steps]]
