"""Session helpers shared by queries, tests and the bench."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "quern") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_OWN_DIRS: dict[str, str] = {}
_SPILLED: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that cuts lineage: spark.checkpoint.dir of the session, else a temporary one (local runs only)."""
    name = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if name:
        return name
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quern-checkpoint-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


def spill(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SPILLED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_spill(spark: SparkSession, path: str) -> None:
    """Remove what spill() wrote once nothing reads it any more."""
    _SPILLED.get(spark.sparkContext.applicationId, set()).discard(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_spills(spark: SparkSession) -> None:
    """Remove all that spill() wrote in this application; results that were not yet written are lost with it."""
    for path in list(_SPILLED.get(spark.sparkContext.applicationId, ())):
        drop_spill(spark, path)


#: Bytes of an input up to which it is dealt out anew. Only how the rows lie depends on it, never which rows come out.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small by Spark's estimate: a small table may be one row group, hence one task, which no read
    setting can split. Larger inputs are read in as many parts as spark.sql.files.maxPartitionBytes gives and never shuffled
    here. For plans without a shuffle of their own."""
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
