"""Table scans, inline tables, sinks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CACHE_PREFIX = "cache_"


def scan(spark: SparkSession, name: str, where: str | None = None) -> DataFrame:
    """A catalog table, optionally filtered by a SQL predicate (pushed to the scan)."""
    df = spark.table(name)
    return df if where is None else df.where(where)


def inline(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """A small reference table from literal rows and an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def register(df: DataFrame, view: str) -> DataFrame:
    """Expose a frame to SQL under a view name; returns the frame."""
    df.createOrReplaceTempView(view)
    return df


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate files: in the shared checkpoint folder, or temporary on a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix="scratch-")


def save_table(df: DataFrame, name: str, replace: bool = False, fmt: str = "parquet", path: str | None = None, partition_by: list[str] | None = None) -> bool:
    """Write a managed (or, with ``path``, external) table. Refuses an existing one unless ``replace``; True if written."""
    spark = df.sparkSession
    if not replace and spark.catalog.tableExists(name):
        return False
    writer = df.write.format(fmt).mode("overwrite" if replace else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return True


def append_table(df: DataFrame, name: str) -> bool:
    """Append to an existing table, aligning columns by name; False if the table is absent."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        return False
    target = spark.table(name)
    missing = [c for c in target.columns if c not in df.columns]
    extra = [c for c in df.columns if c not in target.columns]
    if missing or extra:
        raise ValueError(f"columns differ: missing {missing}, unexpected {extra}")
    df.select(*[F.col(f.name).cast(f.dataType) for f in target.schema]).write.insertInto(name)
    return True


def materialize(df: DataFrame, db: str = "default", path: str | None = None) -> DataFrame:
    """Write under a unique cache name and read back, so later plans start from the stored rows."""
    name = f"{db}.{CACHE_PREFIX}{uuid.uuid4().hex}"
    save_table(df, name, path=path)
    return df.sparkSession.table(name)


def stage(df: DataFrame, keys: list[str], buckets: int | None = None, db: str = "default", path: str | None = None) -> DataFrame:
    """Write a step of a plan bucketed and sorted by its keys (a cache table) and read it back.

    Steps that are stored with the same keys and number of buckets are joined and grouped by the keys as they lie on disk, without an
    exchange. ``buckets`` defaults to the session's shuffle partitions. All rows of a key lie in one bucket, so keys should have few rows
    each, as the steps of a cohort have per person.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{db}.{CACHE_PREFIX}{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a table; False if there was none."""
    if not spark.catalog.tableExists(name):
        return False
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return True


def list_tables(spark: SparkSession, db: str = "default", include_cache: bool = False) -> list[str]:
    """Names of the permanent tables of a database, without cache tables."""
    names = [t.name for t in spark.catalog.listTables(db) if not t.isTemporary]
    return sorted(n for n in names if include_cache or not n.startswith(CACHE_PREFIX))


def purge_cache(spark: SparkSession, db: str = "default") -> bool:
    """Drop every cache table of a database; True if any was dropped."""
    cached = [n for n in list_tables(spark, db, include_cache=True) if n.startswith(CACHE_PREFIX)]
    for n in cached:
        drop_table(spark, f"{db}.{n}")
    return bool(cached)


def analyze(spark: SparkSession, name: str, columns: bool = False) -> None:
    """Refresh the table and collect its statistics for the optimizer."""
    spark.catalog.refreshTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))
