"""Session set-up: a local builder for tests and benches, the work folder, and worker imports."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(app: str = "tonequarry", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine, as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .getOrCreate()
    )


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def on_one_machine(master: str) -> bool:
    return master.split("[")[0] in ("local", "local-cluster")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where it is unset.

    On a cluster a warehouse in a local folder is each machine's own, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        if not on_one_machine(spark.sparkContext.master) and (found.startswith("file:") or ":/" not in found):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the cluster shares; {found} is each machine's own")
    return f"{found.rstrip('/')}/tonequarry-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared work folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and readers agree on the rows.
    """
    path = f"{work_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, by: int = 16) -> DataFrame:
    """df in a sixteenth of the shuffle's partitions, 8 at least: for tables of a few numbers a row, whose tasks would be tiny."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // by))


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written to the shared work folder, once no frame reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
