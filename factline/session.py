"""Session defaults and tables that outlive a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: set[tuple[str, str]] = set()


def build_session(app: str = "factline", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; `conf` overrides (dots written as "__")."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).master(master).config(map=settings).getOrCreate()


BATCH_BYTES = 4_000_000
_batch = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows, so that Python workers hold a few MB of long texts at a time.

    Only where the session has Spark's default of 64 MB; a value that a user has set stays.
    """
    if spark.conf.get(_batch, "67108864b") == "67108864b":
        spark.conf.set(_batch, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: executors do not share the driver's temp folder")
    made = "file://" + tempfile.mkdtemp(prefix="factline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    root = f"{shared_dir(spark)}/factline-{spark.sparkContext.applicationId}"
    if not any(r == root for r, _ in _owned):
        _owned.add((root, spark.sparkContext.applicationId))
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage and keeps the rows when executors are lost; a second use costs a scan, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factline_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by durable() that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._factline_path)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass
