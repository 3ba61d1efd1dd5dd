"""Session-level helpers: the shared folder, written intermediate tables, names that clash with nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows of a file of small rows, where their number is known before they are written.
FILE_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on ``local[n]`` does not name one (tests), a temporary folder is made once per application. On a
    cluster a machine's own folder would hold only what that machine wrote, so there the setting must be given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="waraq-")
    return _own_dirs[app]


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on Arrow batches end at about ``size`` bytes, or after one row that has more.

    Spark's own bound is 64 MB or 10,000 rows, so batches of long texts would fill the workers. A session's own setting stays.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(size))


def materialize(df: DataFrame, tag: str = "table", codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: later actions neither recompute ``df`` nor depend on any executor's local disk, so a lost
    executor costs only the tasks it was running. ``rows``: a bound of its rows, where known; a table of few rows then
    becomes one file for each ``FILE_ROWS`` of them, however many partitions it was dealt over.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/waraq/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{shared_dir(spark).split(':', 1)[-1].lstrip('/')}/waraq/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where it comes in fewer partitions than there are cores (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
