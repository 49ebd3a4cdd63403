"""Session helpers: a local session for tests and benches, shared settings,
and the checkpoint folder taken from the session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "tidemark",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A local session configured as the package expects (tests, bench)."""
    sp = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(sp))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.methodSplitThreshold", "1024")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one already set on the context,
    else ``spark.checkpoint.dir`` from the session or Spark conf. Only a local
    master (tests, single machine) gets a scratch folder when none is set; on
    a cluster that setting must name the folder all machines share."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if not cur:
        cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not cur and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not cur:
        cur = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cur)
    return cur
