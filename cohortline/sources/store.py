"""Stages kept between runs: versioned folders, published one by one.

``<root>/<stage>/<version>`` holds a stage's rows, ``<root>/<stage>/current.json`` its manifest:
version, schema, rows, NULLs per column, further audits, and the versions of its inputs.
The rows are whole before the manifest is renamed into place in one step, so a reader
sees the old stage or the new one, and a run that stopped half way leaves what it had
published.  The audits come out of the write itself (``observe``): no second read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Manifest:
    version: str
    fingerprint: str
    inputs: Mapping[str, str]
    rows: int
    nulls: Mapping[str, int]
    audits: Mapping[str, int | float | str | None]
    schema: dict = field(repr=False)


def audited_write(df: DataFrame, path: str, audits: Mapping[str, Column] | None = None) -> dict:
    """Write a frame and return, from the same job, ``rows``, ``nulls`` per column and further aggregates by name.

    ``audits`` may hold counts, sums, minima and maxima, no distinct counts.
    """
    seen = Observation()
    nulls = {f"null {c}": F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}
    more = {f"audit {k}": v for k, v in (audits or {}).items()}
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in {**nulls, **more}.items()])
    rows.write.mode("overwrite").parquet(path)
    got = seen.get
    cut = lambda kind: {k.removeprefix(kind): v for k, v in got.items() if k.startswith(kind)}
    return {"rows": got["rows"], "nulls": cut("null "), "audits": cut("audit ")}


class StageStore:
    """Stages under one folder.  ``stage`` builds, or resumes what has been published for the same inputs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.built: list[str] = []

    def manifest(self, stage: str) -> Manifest | None:
        """What is published, if anything."""
        try:
            lines = self.spark.read.text(f"{self.root}/{stage}/current.json", wholetext=True).first()
        except AnalysisException:
            return None
        return Manifest(**json.loads(lines[0]))

    def read(self, stage: str) -> DataFrame:
        """The published rows."""
        held = self.manifest(stage)
        if held is None:
            raise LookupError(f"stage {stage} has not been published")
        return self._rows(stage, held)

    def _rows(self, stage: str, held: Manifest) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(held.schema)).parquet(f"{self.root}/{stage}/{held.version}")

    def stage(self, stage: str, build: Callable[[], DataFrame], inputs: Mapping[str, str], audits: Mapping[str, Column] | None = None) -> DataFrame:
        """The stage made from these input versions: read if it is published, else built, written and published.

        ``inputs`` names everything the result depends on: versions of tables, of other
        stages (``version``) and parameters.
        """
        fingerprint = hashlib.sha256(json.dumps(dict(inputs), sort_keys=True).encode()).hexdigest()
        held = self.manifest(stage)
        if held is None or held.fingerprint != fingerprint:
            df, version = build(), f"v-{uuid.uuid4().hex}"
            found = audited_write(df, f"{self.root}/{stage}/{version}", audits)
            held = Manifest(version=version, fingerprint=fingerprint, inputs=dict(inputs), schema=json.loads(df.schema.json()), **found)
            self._publish(stage, held)
            self.built.append(stage)
        return self._rows(stage, held)

    def stages(self, wanted: Mapping[str, tuple[Callable[[], DataFrame], Mapping[str, str]]], at_once: int = 4) -> dict[str, DataFrame]:
        """Several stages that don't read each other, a few at a time; what is finished stays published if one fails."""
        with ThreadPoolExecutor(at_once) as pool:
            jobs = {name: pool.submit(inheritable_thread_target(self.spark)(self.stage), name, *what) for name, what in wanted.items()}
        return {name: job.result() for name, job in jobs.items()}

    def version(self, *stages: str) -> dict[str, str]:
        """Fingerprints of published stages, as inputs of the stages that read them."""
        held = {s: self.manifest(s) for s in stages}
        return {s: m.fingerprint for s, m in held.items() if m is not None}

    def prune(self, stage: str) -> None:
        """Delete the versions of a stage that are no longer published; readers of old versions must be done."""
        held = self.manifest(stage)
        fs, path = self._files(f"{self.root}/{stage}")
        for entry in fs.listStatus(path):
            if entry.isDirectory() and (held is None or entry.getPath().getName() != held.version):
                fs.delete(entry.getPath(), True)

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _publish(self, stage: str, held: Manifest) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fresh, place = hadoop.Path(f"{self.root}/{stage}/.next-{uuid.uuid4().hex}"), hadoop.Path(f"{self.root}/{stage}/current.json")
        fs = fresh.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(held.__dict__).encode()))
        out.close()
        rename = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, place, rename)
