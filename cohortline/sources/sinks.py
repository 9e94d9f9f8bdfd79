"""Full-refresh table writers.

``rebalance`` lets adaptive execution choose file sizes: small partitions are merged
and a period holding most of the rows is split over several tasks and files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def _widened(df: DataFrame, name: str) -> DataFrame:
    """Keep columns the existing table has and ``df`` lacks, as NULL; types must agree."""
    old = df.sparkSession.read.table(name).schema
    new = {f.name: f.dataType for f in df.schema}
    for f in old:
        if f.name in new and new[f.name] != f.dataType:
            raise TypeError(f"column {f.name} changes type: {f.dataType.simpleString()} to {new[f.name].simpleString()}")
    gone = {f.name: F.lit(None).cast(f.dataType) for f in old if f.name not in new}
    order = [f.name for f in old] + [c for c in df.columns if c not in old.names]
    return df.withColumns(gone).select(*order) if gone else df.select(*order)


def overwrite_table(df: DataFrame, name: str, schema: str = "replace", fmt: str = "parquet") -> None:
    """Rewrite a table.  ``schema`` is 'replace' (take the frame's) or 'merge' (widen the table's)."""
    if schema not in ("replace", "merge"):
        raise ValueError("schema must be 'replace' or 'merge'")
    if schema == "merge" and df.sparkSession.catalog.tableExists(name):
        df = _widened(df, name)
    spark, writer = df.sparkSession, df.hint("rebalance").write.format(fmt)
    if fmt == "delta":  # replaces the table in one commit
        writer.mode("overwrite").option("overwriteSchema" if schema == "replace" else "mergeSchema", "true").saveAsTable(name)
        return
    _replace(spark, writer, name)


def _replace(spark: SparkSession, writer: DataFrameWriter, name: str) -> None:
    """The old table steps aside when the new one is whole, and goes when that stands in its place."""
    fresh, old = f"{name}__fresh", f"{name}__old"
    for left in (fresh, old):
        spark.sql(f"DROP TABLE IF EXISTS {left}")
    writer.saveAsTable(fresh)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    except Exception:
        if spark.catalog.tableExists(old):
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def overwrite_bucketed(df: DataFrame, name: str, by: str | Sequence[str], buckets: int) -> None:
    """Rewrite a table in buckets of a key, sorted by it, one file a bucket.

    Tables with the same key (type included) and number of buckets are joined on it, and grouped by it, without a
    shuffle, so each stage pays one when it is written and none when it is attached.  Meant for
    frames with about one row per key: all rows of a key are in one bucket, those without a key too.
    """
    keys = [by] if isinstance(by, str) else list(by)
    _replace(df.sparkSession, df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys), name)


def overwrite_partitioned(df: DataFrame, name: str, path: str, by: str, fmt: str = "parquet") -> None:
    """Rewrite an external table partitioned by a period column."""
    df.hint("rebalance", by).write.format(fmt).mode("overwrite").partitionBy(by).option("path", path).saveAsTable(name)


def refresh_partitions(df: DataFrame, name: str, by: str) -> None:
    """Replace the periods of a partitioned table that ``df`` holds; all others keep their files.

    The new files are staged and moved in when every task has succeeded (dynamic
    partition overwrite), so a failed refresh leaves the old periods readable.
    """
    spark = df.sparkSession
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    rows = df.select(*spark.read.table(name).columns).hint("rebalance", by)
    rows.write.format(facts["Provider"]).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).save(facts["Location"])
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)
