"""Written intermediate tables in the folder that all machines share, and small frame helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: The engine's default limit.
MOST_BUCKETS = 100_000
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
    return spark.conf.get("spark.checkpoint.dir")


def saved(df: DataFrame, name: str = "table", codec: str = "snappy") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Let the shuffle files of a query go when it has ended, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def methods_compiled(spark: SparkSession):
    """Generate no method above 8000 bytes, which the JVM would interpret instead of compiling: wide expressions are split up instead."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped(*frames: DataFrame) -> None:
    """Delete tables written by ``saved`` before the driver ends; nothing may read them any more."""
    paths = {f.written_at for f in frames}
    gone = [w for w in _WRITTEN if w[1] in paths]
    _WRITTEN[:] = [w for w in _WRITTEN if w[1] not in paths]
    for w in gone:
        _delete(*w)


@contextmanager
def scratch():
    """Delete the tables that ``saved`` writes inside when the block ends, but for the frame handed to what it yields."""
    start, stays = len(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        stays.add(df.written_at)
        return df

    try:
        yield keep
    finally:
        gone = [w for w in _WRITTEN[start:] if w[1] not in stays]
        _WRITTEN[start:] = [w for w in _WRITTEN[start:] if w[1] in stays]
        for w in gone:
            _delete(*w)


def bucketed(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """Like ``saved``, bucketed by a key: grouping by it and joining on it read the buckets as they are, without an exchange."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(df.rdd.getNumPartitions(), MOST_BUCKETS))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    _WRITTEN.append((spark, path))
    return spark.table(name)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Hand texts to Python in batches of few bytes instead of many rows: what a worker and its executor hold at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear(spark: SparkSession | None = None) -> None:
    """Delete the tables written by ``saved``; results that still read them must be finished."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def _delete(session: SparkSession, path: str) -> None:
    try:
        at = session._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and with it the way to its files
        return


atexit.register(clear)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster submits it with ``--py-files``)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
