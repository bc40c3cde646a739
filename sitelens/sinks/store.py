"""A set of tables that is published as one: versioned folders, a manifest per load, one pointer.

    <root>/data/<table>/load=<id>/[company_id=<n>/]...   rows that a load has written
    <root>/manifests/load=<id>/...                       where every tenant's rows lie, complete
    <root>/versions/...                                  one row per published load, in a file of its own

A load writes its rows into folders of its own, then its manifest, and last one row of
``versions``; that single file is the switch. Readers take the newest row, its manifest, and
of the folders named there only the tenants that the manifest lists. Whatever a load had
written when it died is named by no manifest, so the old set stays readable as it was.

A manifest has one row per table and tenant (and load, where rows are appended), not per file.
Loads of one store are run one after another; of two that ran at once and published the same
number, the smaller load id is the version and the other raises.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

MANIFEST = "table_name string, company_id bigint, load_id string, rows bigint"
VERSIONS = "version bigint, load_id string, schemas map<string,string>, published_at timestamp"
# Manifest rows of a table that may be broadcast to its scan.
FEW_ENTRIES = 200_000
# Tenants of a load up to which every task writes a file of each.
FEW_TENANTS = 16


class LostRace(RuntimeError):
    """Another load has published the same version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
        """Every write of a store goes through here."""
        writer = df.write.mode(mode)
        (writer.partitionBy(*by) if by else writer).parquet(path)

    def _existing(self, schema: str, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> Row | None:
        """The newest version: its number, its load and the schemas of its tables."""
        return self._existing(VERSIONS, f"{self.root}/versions").orderBy(F.desc("version"), "load_id").limit(1).first()

    def manifest(self, version: Row | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/load={version.load_id}")

    def read(self, table: str, version: Row | None = None) -> DataFrame | None:
        """A table as of a version, by default the newest. None: the set has no such table."""
        version = version or self.current()
        if version is None or table not in version.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(version.schemas[table]))
        entries = self.manifest(version).where(F.col("table_name") == table)
        # As many rows as loads that still hold rows of the table.
        loads = entries.groupBy("load_id").agg(F.count("company_id").alias("tenants")).collect()
        if not loads:
            return self.spark.createDataFrame([], schema)
        per_tenant = any(x.tenants for x in loads)
        at = f"{self.root}/data/{table}"
        stored = T.StructType([f for f in schema if not per_tenant or f.name != "company_id"])
        if per_tenant:
            stored = stored.add("load", T.StringType()).add("company_id", T.LongType())
        rows = self.spark.read.schema(stored).option("basePath", at).parquet(*[f"{at}/load={x.load_id}" for x in loads])
        if per_tenant:
            named = entries.select("company_id", F.col("load_id").alias("load"))
            few = sum(x.tenants for x in loads) <= FEW_ENTRIES
            rows = rows.join(F.broadcast(named) if few else named, ["company_id", "load"], "left_semi")
        return rows.select(*schema.names)

    def begin(self) -> "Load":
        return Load(self)

    def remove_tenant(self, company_id: int) -> None:
        """Take one tenant out of every table, audit and reports included, then delete its partitions."""
        load = self.begin()
        load.publish(without=company_id)
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/*/load=*/company_id={int(company_id)}")
        fs = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in fs.globStatus(pattern) or []:
            fs.delete(found.getPath(), True)


class Load:
    """One attempt: what it has written so far, and its publication."""

    def __init__(self, store: Store):
        self.store, self.id = store, uuid.uuid4().hex
        self.tenants: int | None = None  # how many it loads, where the loader knows
        self.base = store.current()
        self.started_at = dt.datetime.now(dt.timezone.utc)
        self.schemas: dict[str, str] = dict(self.base.schemas) if self.base else {}
        self.observed: dict[str, dict[str, int]] = {}  # table -> metrics of its write
        self.written: dict[str, DataFrame] = {}        # table -> (company_id, rows)

    def write(self, table: str, df: DataFrame, per_tenant: bool = True, **metrics) -> DataFrame:
        """Write a table's rows into this load's folder and read them back.

        ``rows`` and further aggregates are observed on the write itself, behind the last
        exchange, so that no retried task counts twice. Rebalancing gives a large tenant
        several files and keeps small ones in one. Rows of few tenants are written where they
        are: their files are few anyhow, and a shuffle of all rows would gain nothing.
        """
        seen = Observation()
        path = f"{self.store.root}/data/{table}/load={self.id}"
        watched = (df.hint("rebalance", "company_id") if per_tenant and not self._few() else df).observe(
            seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()])
        self.store.save(watched, path, by=["company_id"] if per_tenant else None)
        self.schemas[table] = df.schema.json()
        self.observed[table] = {k: v or 0 for k, v in seen.get.items()}
        stored = self.store.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        # Counted from partition names and file footers alone.
        self.written[table] = stored.groupBy("company_id").agg(F.count(F.lit(1)).alias("rows")) if per_tenant else \
            stored.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(None).cast("bigint").alias("company_id"), "rows")
        return stored

    def keep_schema(self, table: str, schema: T.StructType) -> None:
        """A table of the set in which this load has no rows."""
        self.schemas.setdefault(table, schema.json())

    def publish(self, tenants: DataFrame | None = None, replaced: list[str] = (), globals_: list[str] = (),
                appended: list[str] = (), without: int | None = None) -> int:
        """Write the manifest, then the pointer; the version's number.

        In ``replaced`` tables all rows of ``tenants`` give way to this load's, in ``globals_``
        the whole table does; ``appended`` ones keep their rows. ``without``: a tenant to leave out.
        """
        spark = self.store.spark
        old = self.store.manifest(self.base)
        kept = old.where(~F.col("table_name").isin([*replaced, *globals_]))
        if replaced:
            kept = kept.unionByName(old.where(F.col("table_name").isin(list(replaced)))
                                    .join(tenants.select("company_id").distinct(), "company_id", "left_anti").select(*old.columns))
        for table in [*replaced, *globals_, *appended]:
            if table in self.written:
                fresh = self.written[table]
                if table in replaced:
                    fresh = fresh.join(tenants.select("company_id").distinct(), "company_id", "left_semi")
                kept = kept.unionByName(fresh.select(F.lit(table).alias("table_name"), "company_id",
                                                     F.lit(self.id).alias("load_id"), "rows"))
        if without is not None:
            kept = kept.where(~F.col("company_id").eqNullSafe(F.lit(without)))
        self.store.save(kept, f"{self.store.root}/manifests/load={self.id}")
        number = self.base.version + 1 if self.base else 1
        pointer = spark.createDataFrame([(number, self.id, self.schemas, dt.datetime.now(dt.timezone.utc))], VERSIONS)
        self.store.save(pointer.coalesce(1), f"{self.store.root}/versions", mode="append")
        now = self.store.current()
        if now.version == number and now.load_id != self.id:
            raise LostRace(f"version {number} of {self.store.root} was published by load {now.load_id}")
        return number

    def drop_unpublished(self, tables: list[str], tenants: DataFrame) -> None:
        """Delete what this load, once published, has written of tenants that it did not publish.

        Its manifest lists them in none of ``tables``, and no other manifest names this load. In a
        load of many tenants the folders stay, unnamed, rather than be deleted one by one.
        """
        if not self._few():
            return
        paths = [f"{self.store.root}/data/{t}/load={self.id}/company_id={row.company_id}"
                 for row in tenants.select("company_id").distinct().collect() for t in tables if t in self.written]
        for path in paths:
            at = self.store.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.store.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _few(self) -> bool:
        return self.tenants is not None and self.tenants <= FEW_TENANTS
