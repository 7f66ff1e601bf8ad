"""Session helpers: a local builder for tests and the lineage cut used by loops."""

import gc
import tempfile
import time
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


# Where cut_lineage wrote the tables that are still in use.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: str = "8", app: str = "lorelink", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local master gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="lorelink-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read on from there.

    A Parquet table rather than ``checkpoint()``: the plan below runs once, and
    the reader keeps sizes for join planning and prunes columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` returned.

    Only for tables from which nothing is read any more: what was made from them has to be written by now.
    """
    for frame in frames:
        named = _WRITTEN.pop(frame, None)
        if named is not None:
            spark = frame.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(named)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now: the driver cleans up what it no longer refers to when it collects its garbage.

    Twice, as the last job is still referred to when the first collection begins.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
