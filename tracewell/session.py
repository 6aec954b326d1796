"""Session helpers: where shared intermediate tables live and how they are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
_SHARED: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tracewell-")
    return _LOCAL_SCRATCH[app]


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor replays one table read instead of the span search, and
    gives the readers column pruning plus real file sizes for their join choices.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``staged`` has written, once everything made from it is written too."""
    path = table._staged_path
    jvm = table.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand texts to Python in batches of about four megabytes, unless the session names a size itself.

    Without it a batch is 10,000 rows, however long their texts, in the executor and in each Python worker at once.
    """
    if spark.conf.get(ARROW_BYTES, None) is not None:
        yield
        return
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


BROADCAST_ROWS = 2_000_000  # of a number or two: 32 MB


def matching(df: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the written table ``ids`` of just these columns.

    The ids travel to the rows only if they are counted to be few; beyond that both sides are shuffled.
    """
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, list(key), "left_semi")


def shared_table(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """Build a derived table once per application and input folder, then reuse the written copy."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _SHARED:
        df = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _SHARED[key] = path
    return spark.read.parquet(_SHARED[key])


SPREAD_SPLITS = 64  # 8 GB at the usual split size


def spread(scan: DataFrame, key: str, per_core: int = 4) -> DataFrame:
    """Rows of a scan of few splits over enough partitions for compute-heavy columns.

    A table of ``SPREAD_SPLITS`` splits or more is returned untouched, however large the cluster, so no table of more
    than some gigabytes is ever shuffled for this. Use it on scans with filters and projections only.
    """
    want = per_core * scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= min(want, SPREAD_SPLITS):
        return scan
    return scan.repartition(want, F.xxhash64(key))


def forget_shared_tables() -> None:
    """Drop the registry of written tables; the next query builds them afresh."""
    _SHARED.clear()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative MLlib fits a checkpoint folder where the cluster has not named one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
