"""Tables that change together: snapshots of parts in folders, and one manifest a version.

A commit writes the data of all its tables first, each part into a folder of its own, and then one
small Parquet file that names the folders of every table. A reader sees the newest manifest, so that a run
that dies between two tables leaves the version before as it was; what it wrote is named nowhere. A
part that does not change is named again, not copied. Going back is a manifest with the old names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

MANIFEST = "table string, part string, folder string, schema string, run string"


class Versions:
    """The tables under a path that driver and executors share. Versions are numbered from 1; 0 has no tables.

    One writer at a time: a second one that commits the same number fails, as its folder exists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{MANIFEST}, version int").option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None

    def version(self) -> int:
        found = self._manifests()
        return found.agg(F.max("version")).first()[0] or 0 if found is not None else 0

    def _entries(self, version: int) -> list:
        """The manifest's rows: one a part, so as many as there are parts (days) of all tables."""
        found = self._manifests() if version else None
        return found.filter(F.col("version") == version).collect() if found is not None else []

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version (the newest if it is None); None where there is none."""
        own = [r for r in self._entries(self.version() if version is None else version) if r["table"] == table]
        if not own:
            return None
        schema = StructType.fromJson(json.loads(own[0]["schema"]))
        folders = [r["folder"] for r in own if r["folder"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def run_of(self, version: int | None = None) -> dict:
        entries = self._entries(self.version() if version is None else version)
        return json.loads(entries[0]["run"]) if entries else {}

    def commit(self, whole: dict[str, DataFrame] | None = None, parts: dict[str, tuple[DataFrame, str, list[str]]] | None = None, run: dict | None = None) -> int:
        """Write a version; its number.

        whole: tables that are replaced. parts: table: (rows, column, values): the rows replace those parts whose value of the
        column is in `values` (as text: letters, digits, dots and hyphens, `null` for null), the others stay; a row with another value is an error.
        """
        base = self.version()
        before = self._entries(base)
        changed: dict[str, list[tuple]] = {}
        for name, df in (whole or {}).items():
            folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folder)
            changed[name] = [("", folder, df.schema.json())]
        for name, (df, column, values) in (parts or {}).items():
            folder, part = f"{self.path}/data/{name}/{uuid.uuid4().hex}", F.coalesce(F.col(column).cast("string"), F.lit("null"))
            df.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(folder)
            names = StructType([*df.schema.fields, StructField("_part", StringType())])
            there = {r[0] for r in self.spark.read.schema(names).parquet(folder).select("_part").distinct().collect()}
            if extra := there - set(values):
                raise ValueError(f"rows of other parts: {sorted(extra)[:5]}")
            kept = [(r["part"], r["folder"], r["schema"]) for r in before if r["table"] == name and r["part"] not in values]
            schema = df.schema.json()
            changed[name] = [(p, f, schema) for p, f, _ in kept if f] + [(v, f"{folder}/_part={v}", schema) for v in sorted(there)] or [("", "", schema)]
        rows = [(r["table"], r["part"], r["folder"], r["schema"]) for r in before if r["table"] not in changed]
        rows += [(name, *entry) for name, entries in changed.items() for entry in entries]
        return self._manifest(base + 1, rows, run or {})

    def back_to(self, version: int, run: dict | None = None) -> int:
        """A new version that has the tables of an old one. Nothing is copied."""
        rows = [(r["table"], r["part"], r["folder"], r["schema"]) for r in self._entries(version)]
        return self._manifest(self.version() + 1, rows, run or {"back_to": version})

    def _manifest(self, version: int, rows: list[tuple], run: dict) -> int:
        note = json.dumps(run, default=str)
        self.spark.createDataFrame([(*r, note) for r in rows], MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/commits/version={version}")
        return version
