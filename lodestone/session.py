"""Session plumbing: reading tables, shipping the package to executors, and steps written to the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
#: Spark's own setting by which shuffle files go as soon as the execution that wrote them ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own settings of the bytes up to which a join's side is broadcast: before it has been computed, and after that.
PLANNED, COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes of rows up to which a side that has been computed is broadcast.
BROADCAST_BYTES = 2 << 20
#: Rows of a task of ``spread``, about.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; any path Spark's own readers open will do."""
    tidy(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestone-")  # the driver serves the file for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lodestone.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(PACKAGE_DIR):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, PACKAGE_DIR)))
    sc.addPyFile(archive)
    sc._lodestone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Only where that is unset and the master is local does a temporary folder take its place; a cluster without it
    is an error, since executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not getattr(sc, "_lodestone_folder", None):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc._lodestone_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, sc._lodestone_folder, ignore_errors=True)
    return sc._lodestone_folder


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has Spark delete an execution's shuffle files when it ends, and broadcast by counted bytes only; a session may switch
    both off again.

    Before a side has been computed Spark goes by the bytes of its files, which say little of the rows: a few megabytes of
    compressed columns can be many millions of rows, all of which the driver would hold. Sides that are broadcast by name still are.
    """
    if not getattr(spark, "_lodestone_tidy", False):
        spark.conf.set(CLEAN, "true")
        spark.conf.set(PLANNED, "-1")
        spark.conf.set(COUNTED, str(BROADCAST_BYTES))
        spark._lodestone_tidy = True


def scratch(spark: SparkSession) -> str:
    """A folder of its own for a step, in the shared folder; what is left there is deleted when the application ends."""
    sc = spark.sparkContext
    top = f"{shared_folder(spark)}/lodestone-{sc.applicationId}"
    if top not in getattr(sc, "_lodestone_tops", ()):
        sc._lodestone_tops = {top, *getattr(sc, "_lodestone_tops", ())}
        atexit.register(_last, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there.

    The files survive lost executors; ``by`` keeps the rows of each of its few values in files of their own. ``discard`` deletes them once they are used; what is left is deleted when
    the application ends.
    """
    spark = df.sparkSession
    tidy(spark)
    folder = scratch(spark)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any column name will do
    write = plain.write.option("compression", "zstd")
    (write.partitionBy(f"c{df.columns.index(by)}") if by else write).parquet(folder)
    back = spark.read.schema(plain.schema).parquet(folder).select(*plain.columns).toDF(*df.columns)
    back._lodestone_at = folder
    return back


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by the columns, to so many tasks that what one of them holds does not grow with the rows; for tables whose
    rows are counted cheaply."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS_A_TASK)), *by)


def together(*dfs: DataFrame) -> DataFrame:
    """The rows of checkpointed tables of one schema, in one scan however many they are."""
    first = dfs[0]
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(first.schema.fields)])
    read = first.sparkSession.read.schema(plain).parquet(*[df._lodestone_at for df in dfs])
    return read.select(*plain.names).toDF(*first.columns)


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of checkpointed tables that nothing reads any more."""
    for df in dfs:
        delete(df.sparkSession, df._lodestone_at)


def _last(spark: SparkSession, top: str) -> None:
    try:
        delete(spark, top)
    except Exception:  # the application is gone already
        shutil.rmtree(top.removeprefix("file://"), ignore_errors=True)
