"""Session factory and the two session-level helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster; sizes come from the launcher.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files of ``cut`` go with the frames that read them
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "kgloom", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the launcher makes the session."""
    cores = cores or os.cpu_count() or 4
    conf = DEFAULTS | {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | extra
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only on one machine (a local master) an unset one is made up; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kgloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files outlive any executor, unlike a local checkpoint.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    # A checkpointed plan keeps the constraints of the plan before it, and those of a self-join are the product of
    # both sides': over the rounds of an iterative operator planning would come to take longer than the work.
    session = df.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(rows, session)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
