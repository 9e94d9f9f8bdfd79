"""Readers and writers."""

from cohortline.sources.readers import read_path, read_rules_csv, read_table, table_from
from cohortline.sources.schemas import INPUTS, TABLES, schema_of
from cohortline.sources.sinks import overwrite_bucketed, overwrite_partitioned, overwrite_table, refresh_partitions
from cohortline.sources.store import Manifest, StageStore, audited_write

__all__ = [
    "INPUTS", "Manifest", "StageStore", "TABLES", "audited_write", "overwrite_bucketed", "overwrite_partitioned", "overwrite_table", "read_path",
    "read_rules_csv", "read_table", "refresh_partitions", "schema_of", "table_from",
]
