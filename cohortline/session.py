"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# forceOptimizeSkewedJoin lets adaptive execution split a skewed join input even when
# the operator above it then needs one more exchange.  Most joins here feed a
# group-by or a one-row-per-key step, so without it the split would be given up
# exactly where it is needed; the exchange it adds carries pre-aggregated rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str | None:
    """A new place in this application's part of the shared folder, if there is one; ``forget`` deletes it."""
    folder = shared_folder(spark)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}" if folder else None


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later steps read, and read it back.

    A written table survives the loss of executors, cuts the plan, and still lets each
    reader take only its columns and rows.  Without a shared folder the frame stays
    lazy, which costs time but changes nothing else.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if not path:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what ``keep`` has written in this application; call it when the results are out."""
    folder = shared_folder(spark)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
