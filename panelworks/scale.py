"""Helpers that keep plans safe on large inputs: size-checked broadcasts and reliable cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows of a parameter table that may become literals of a plan.
BROADCAST_ROW_LIMIT = 20_000


def fetch_if_small(params: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame | None:
    """Return ``params`` as a local table when it has at most ``row_limit`` rows, else None."""
    rows = params.limit(row_limit + 1).collect()
    if len(rows) > row_limit:
        return None
    return params.sparkSession.createDataFrame(rows, params.schema)


def attach(fact: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key parameters to a fact table.

    The parameters are written once, so that they are never computed twice, and Spark knows their size in bytes: below
    ``spark.sql.autoBroadcastJoinThreshold`` they are broadcast, so the fact side is not shuffled and a hot key costs
    nothing. Larger ones are joined by a shuffle, where adaptive execution splits skewed partitions of the fact side.
    """
    return fact.join(cut_lineage(params, "parameters"), list(keys), how)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers get Arrow batches of about ``size`` bytes from what is run inside; rows are the same in any batches.

    Batches are held by the executor and by the worker, twice while they grow, so long texts call for small ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's setting.

    Where it is unset, as in local tests, each application gets one temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = tempfile.mkdtemp(prefix="panelworks-")
        folder = _own_folders[application]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return f"{shared_folder(spark)}/panelworks/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later jobs neither recompute nor lose it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
