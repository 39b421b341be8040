"""Tables written to the folder that driver and executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own; a cluster, whose
    machines would each see another, is told so."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not re.fullmatch(r"local(\[[^\],]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        _OWN_DIRS[app] = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again; ``by`` a column whose values get folders of their own, so that a filter on
    it reads no more than it needs."""
    path = new_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``staged`` table that no plan will read any more."""
    if path := getattr(df, "staged_path", None):
        target, files = file_system(df.sparkSession, path)
        files.delete(target, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, with a dense number from 0 in its order in a column ``name``: partitions are counted, one small row
    each, and no row is shuffled or gathered for it."""
    placed = staged(df.select("*", F.spark_partition_id().alias(f"{name}_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(f"{name}_nth")), "numbered")
    rows = placed.groupBy(f"{name}_part").agg((F.max(f"{name}_nth") + 1).alias("size")).orderBy(f"{name}_part").collect()
    firsts, total = [], 0
    for part, size in rows:
        firsts.append((part, total))
        total += size
    starts = df.sparkSession.createDataFrame(firsts, f"{name}_part int, {name}_first long")
    return placed.join(F.broadcast(starts), f"{name}_part").select(*df.columns, (F.col(f"{name}_first") + F.col(f"{name}_nth")).alias(name))


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system objects for ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
