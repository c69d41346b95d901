"""Session factory and the shared place for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "packloom") -> SparkSession:
    """A session for local work; on a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Local inputs are so small that coalescing by size would leave one task; the few partitions stay.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a local session (tests, one machine) gets a temporary folder; a session on a cluster raises an
    error, for a folder of the driver's machine is none that executors share.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="packloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: for relations read several times, each time in part."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_shared(df: DataFrame) -> None:
    """Delete the files of a table that ``write_shared`` gave."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
