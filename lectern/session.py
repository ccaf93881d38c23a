"""Session helpers: local sessions for tests, the shared folder, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a checked broadcast may hold; a side above it is shuffled instead.
BROADCAST_ROWS = 2_000_000
#: Parts that a hot value is spread over in a join that can't be broadcast.
SALT = 16


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lectern") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="lectern-ship-")) / "lectern.zip"
    with zipfile.ZipFile(into, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # the driver's own temporary folder: Spark copies the file to every executor
    sc.addPyFile(str(into))
    sc._lectern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a local one is made and set; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all written tables of this folder of the shared one. To be called when nothing reads them any more; checkpoints are Spark's own to clean."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lectern")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df from reliable storage, its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes straight from fewer splits than there are cores: a table that small is shuffled cheaply, and Python work on it isn't done by one task. Others stay as they are."""
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    # a plan with a shuffle has its own partitioning, and asking for it would run it
    if plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan") or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def keep_matching(df: DataFrame, keys: DataFrame, on: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose `on` is in keys: the keys are broadcast only if counted at most `bound`, else shuffled."""
    keys = keys.select(on).distinct()
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: str, how: str = "inner", bound: int = BROADCAST_ROWS, salt: int = SALT) -> DataFrame:
    """df joined ("inner" or "left") with a table that has each `on` once: broadcast if counted at most `bound`; else the table is repeated `salt` times, so that a hot value of df is spread over as many tasks.

    The table is counted, so it should come from storage.
    """
    if table.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(table), on, how)
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int")).join(many, [on, "_salt"], how).drop("_salt")
