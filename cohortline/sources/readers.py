"""Reading tables, directories and the rule file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortline.sources.schemas import schema_of

RULES_SCHEMA = T.StructType(
    [
        T.StructField("program", T.StringType()),
        *[T.StructField(f"sc{i}", T.IntegerType()) for i in range(1, 5)],
        T.StructField("seq", T.IntegerType()),
        T.StructField("product", T.StringType()),
    ]
)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table."""
    return spark.read.table(name)


def read_path(spark: SparkSession, fmt: str, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A directory table of any format the session has ('parquet', 'orc', 'delta' where installed)."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_rules_csv(spark: SparkSession, path: str, schema: T.StructType = RULES_SCHEMA) -> DataFrame:
    """The recommendation rule file: header line, declared schema, bad lines fail."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def table_from(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` under its declared schema; a declared column that the file lacks is an error."""
    path, schema = f"{folder.rstrip('/')}/{name}.parquet", schema_of(name)
    missing = set(schema.names) - set(spark.read.parquet(path).columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return spark.read.schema(schema).parquet(path)
