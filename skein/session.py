"""Session helpers: one place that knows where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_path(df: DataFrame) -> str:
    """The checkpoint folder of the context, which is set if it was not.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where neither that setting nor a
    context folder exists, and the master is local, a temporary folder is chosen.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skein-checkpoint-")
        sc.setCheckpointDir(folder)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_path(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the checkpoint folder.

    For iterations whose rounds build on each other: a checkpointed plan keeps the statistics and constraints that were
    inferred for it, which multiply from round to round until planning takes longer than the work; a table read back
    knows nothing but its columns. :func:`discard` removes the table.
    """
    path = f"{checkpoint_path(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of :func:`written` from which nothing will be read any more; others are left alone."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
