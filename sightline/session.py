"""Session defaults for local use (on a cluster the submitter's settings hold), and folders that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process by application, and where written tables lie.
_OWN: dict[str, str] = {}
_BASE: dict[tuple[str, str], str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def session(cores: int = 8, app: str = "sightline") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is
    set, a temporary one for a local master; elsewhere executors would write to disks of their own, so that it is an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sightline-")
    return _OWN[app]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a new folder below the shared one; all of an application's folders are deleted when the process ends."""
    base = shared_dir(spark)
    key = (spark.sparkContext.applicationId, base)
    if key not in _BASE:
        _BASE[key] = f"{base}/sightline-{uuid.uuid4().hex}"
        atexit.register(_sweep, spark, _BASE[key])
    return f"{_BASE[key]}/{label}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the context may be gone by now
        delete(spark, path)


#: Spark's setting that deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def own_shuffles(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind (where Spark has the setting)."""
    if not spark.conf.isModifiable(CLEAN_UP):
        yield
        return
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """df as rows whose size Spark knows, so that joins with it are planned by that, if there are at most so many (it is
    computed for this); else df as it is."""
    found = df.limit(rows + 1).toArrow()
    return df if found.num_rows > rows else df.sparkSession.createDataFrame(found, df.schema)


def release(*written: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing will read again."""
    for df in written:
        path = _PATHS.pop(df, None)
        if path:
            delete(df.sparkSession, path)
