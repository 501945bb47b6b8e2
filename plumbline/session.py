"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import Refusal

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "plumbline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and frozen tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there the driver is also the executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise Refusal("CHECKPOINT_DIR_UNSET", f"set {CHECKPOINT_CONF} to a shared folder")
        configured = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(configured)
    return configured


def freeze(frame: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back.

    The stored rows survive executor loss, a later action sees exactly the same rows, and
    the upstream plan runs once (an unpersisted checkpoint would run its last stage twice).
    """
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/frozen-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables frozen for one computation, removed together when it is done.

    Use as a context manager around work whose result is itself written:
    everything frozen through the scratch is deleted from the shared folder at the end, unless ``keep``
    was called because the result still reads it.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def freeze(self, frame: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self._spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._paths.append(path)
        frame.write.parquet(path)
        return self._spark.read.schema(frame.schema).parquet(path)

    def keep(self) -> None:
        self._paths.clear()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        jvm, hadoop = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        for text in self._paths:
            path = jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(hadoop).delete(path, True)
        self._paths.clear()


#: Rows that one task sorts or groups: some hundred MB at most, however many rows there are.
TASK_ROWS = 250_000


def tasks_for(frame: DataFrame, rows: int | None = None) -> int:
    """Number of tasks for a shuffle of as many rows as ``frame`` has: it grows with the input, so the memory of one task does not.

    The rows are counted without their columns, which reads no more than the footers of a plain table.
    """
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(frame.count() if rows is None else rows) // TASK_ROWS))


def spread(frame: DataFrame) -> DataFrame:
    """Give CPU-heavy row work all cores when the input has fewer splits than cores.

    For plain scans only: counting their splits runs nothing. A large input has far more
    splits than cores and passes through without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.isStreaming or frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)
