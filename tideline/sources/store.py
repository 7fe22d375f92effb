"""Derived tables that many queries share: written once to the folder that all executors share, or cached where none is named."""

from __future__ import annotations

import hashlib
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_ROOT: dict[str, str] = {}
_DONE: dict[tuple[str, str, str, int], str | DataFrame] = {}


def shared(spark: SparkSession) -> str | None:
    """The checkpoint folder that the cluster names, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or None


def root(spark: SparkSession) -> str:
    """Folder for sinks: in the cluster's checkpoint folder, or else in its warehouse. A session beyond this machine must name one that is not
    on this machine alone."""
    app = spark.sparkContext.applicationId
    if app not in _ROOT:
        base = shared(spark)
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
                raise ValueError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder that the driver and all executors share")
        _ROOT[app] = f"{base.rstrip('/')}/tideline-{app}-{uuid.uuid4().hex[:8]}"
    return _ROOT[app]


def _key(spark: SparkSession, name: str, sf_dir: str) -> tuple:
    from ..operators import panel

    return spark.sparkContext.applicationId, name, sf_dir, panel.CHUNK


def written(spark: SparkSession, name: str, sf_dir: str, build) -> str:
    """Path of ``build()``, written on first use in this application."""
    key = _key(spark, name, sf_dir)
    if not isinstance(_DONE.get(key), str):
        path = f"{root(spark)}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:10]}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _DONE[key] = path
    return _DONE[key]


def stored(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """``build()``, made once in this application: a written table, or without a shared folder a cached one, whose lost parts Spark
    makes again from the given tables."""
    if shared(spark):
        return spark.read.parquet(written(spark, name, sf_dir, build))
    key = _key(spark, name, sf_dir)
    if key not in _DONE:
        _DONE[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _DONE[key]
