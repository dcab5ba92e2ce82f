"""Session, table access and the few physical-plan helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a dimension may have before it is no longer broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
#: Bytes of a scan's split that is surely a row group or more.
FULL_SPLIT = 64 << 20


def build_session(cores: str = "8", app: str = "nordlys", memory: str = "12g") -> SparkSession:
    """A local session with the settings the queries are tuned for; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, derived: bool = False, width: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a dimension, given only after its rows and bytes were counted.

    Beyond ``rows`` rows or ``width`` bytes (of the rows as JSON) the frame is
    returned without the hint, so the join is a shuffled one that adaptive
    execution may still split on skew.  A dimension ``derived`` from a corpus is
    written first, so that measuring it and joining it don't compute it twice.
    A plan whose scans hold next to nothing needs no count.
    """
    df = materialize(df) if derived else df
    if not derived and _tiny(df):
        return F.broadcast(df)
    each = F.octet_length(F.to_json(F.struct("*")))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= width else df


def _tiny(df: DataFrame) -> bool:
    """Whether the optimizer's own estimate, which multiplies over joins, is under a quarter of a megabyte without any generator."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) < 1 << 18 and "Generate " not in plan.toString()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's scans; leaves of unknown size count as nothing (estimates of joins are left out)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def _well_split(df: DataFrame, least: int) -> bool:
    """Whether a plan of scans alone is read in at least ``least`` pieces that hold rows.

    Splits smaller than a row group are empty, so either the files must be as
    many, or the bytes enough for as many full splits.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if any(word in text for word in ("Join", "Aggregate", "Repartition", "Window", "Sort", "Union")) or df.rdd.getNumPartitions() < least:
        return False
    leaves = plan.collectLeaves()
    files = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return False
        files += len(leaf.relation().location().inputFiles())
    return files >= least or input_bytes(df) >= least * FULL_SPLIT


def spread(df: DataFrame, *keys: str, per_task: int = 16 << 20, floor: int = 3) -> DataFrame:
    """Enough tasks for CPU-heavy Python work, without a shuffle where the scan gives them.

    A scan of many files or row groups is left alone (its tasks' size is set by
    ``spark.sql.files.maxPartitionBytes``).  Anything else is hash-partitioned;
    the number of tasks follows the scans' bytes and is never under ``floor``
    times the cluster's cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _well_split(df, cores):
        return df
    n = max(floor * cores, min(200_000, input_bytes(df) // per_task))
    return df.repartition(int(n), *[F.col(k) for k in keys])


def enough_tasks(df: DataFrame, key: str) -> DataFrame:
    """Hash-partitions a scan that has fewer splits than the cluster has cores; else leaves it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, F.col(key)) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A local session without one gets a temporary folder; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='nordlys-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(shutil.rmtree, where[7:], ignore_errors=True)
    return where


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A path of its own in the shared folder, removed from whatever file system it lies on when the session's JVM ends."""
    path = f"{shared_dir(spark)}/nordlys-{name}{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder (survives lost executors).

    Unlike ``checkpoint()`` the plan runs once, and what is written is columnar.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def data_dir(scale: str = "sf0.001") -> str:
    return os.environ.get("NORDLYS_DATA", "/root/testdata") + "/" + scale
