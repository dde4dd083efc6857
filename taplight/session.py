"""Session settings this package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps epoch arithmetic stable; AQE sizes shuffles and splits skewed joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def build_session(app_name: str = "taplight", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession) -> bool:
    """True when a reliable checkpoint folder is set.

    The folder is the one the session names. Only a local master, where the driver and
    the executors share a disk, gets a folder of its own when none is named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return True
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="taplight-checkpoint-")
    if folder:
        context.setCheckpointDir(folder)
    return bool(folder)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder."""
    if not checkpoint_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, or the plan where none is set.

    Used where a result is read several times: recomputing it would multiply with every
    ordered pass stacked on top, and a lost executor would replay the whole chain. A
    written table is read back by column and tells the optimizer its true size.
    """
    spark = df.sparkSession
    if not checkpoint_ready(spark):
        return df
    path = scratch_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
