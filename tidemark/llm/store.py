"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Input bytes that one reduce partition takes, for the partition counts below.
PARTITION_BYTES = 16 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and as before after it."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, size: str) -> AbstractContextManager[None]:
    """Bounds the batches that Python stages of the actions inside get."""
    return settings(spark, {_ARROW: size})


def written(df: DataFrame, name: str, by: str | None = None, arrow_bytes: str = "16m") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives
    lost executors, and has a size that the planner knows. ``arrow_bytes``
    bounds the batches that its Python stages get."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    with settings(spark, {_CLEAN: "true", _ARROW: arrow_bytes}):  # what was shuffled for the table isn't needed beside it
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
