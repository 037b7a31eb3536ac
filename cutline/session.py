"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cutline", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CUTLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application: they unpickle functions by module name."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "cutline.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, for whole texts may be long; a smaller setting is left alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Bytecode beyond which the JVM leaves a method to its interpreter.
COMPILED_BYTES = 8_000


def bound_methods(spark: SparkSession, wide: bool) -> None:
    """Wide rows generate methods that the JVM never compiles; beyond its limit Spark is to take operators one by one.

    A smaller setting is left alone; a query without wide rows gets back what stood before.
    """
    name, kept = "spark.sql.codegen.hugeMethodLimit", "cutline.methods"
    now, before = int(spark.conf.get(name)), spark.conf.get(kept, None)
    if wide and now > COMPILED_BYTES:
        spark.conf.set(kept, str(now))
        spark.conf.set(name, str(COMPILED_BYTES))
    elif not wide and before is not None and now == COMPILED_BYTES:
        spark.conf.set(name, before)


def shipped(fn, *, wide: bool = False):
    """The query ``fn(spark, ...)``, whose workers can import this package. ``wide``: see :func:`bound_methods`."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *args):
        ship(spark)
        bound_batches(spark)
        bound_methods(spark, wide)
        return fn(spark, *args)

    return run


def use_utc(spark: SparkSession) -> SparkSession:
    """Every clock in this library is UTC; zone names are always explicit."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, which the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only for a local master that names none, as in tests;
    on a cluster a missing name is an error.
    """
    named, set_ = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("cutline.shared", None)
    if named is None and set_ is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = named or set_
    if folder != set_:
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("cutline.shared", folder)
    return folder


#: Codec of stored stages and datasets; smaller than the default at about the same time.
STORED_AS = "zstd"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For a stage that several branches read: each branch then prunes columns and
    filters at the scan, the planner knows the size, and a lost executor costs a
    re-read instead of the whole lineage.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder: for iterative plans."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
