"""Session helpers shared by the whole library."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_folio_shipped", False):
        return
    context._folio_shipped = True
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folio-code-")) / "folioframe.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, by any path Spark can open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` spread over all cores where they come from fewer files than there are cores.

    A small table is often one file with one row group, which one task reads
    whatever its splits; work that is long per row goes over it first. Tables of
    many files stay as they are.

    Spark would move a filter, and with it all that is computed for it, in front of
    the exchange, and compute it again behind: an explode has such a filter of its
    own. The one here holds for every row and lets no other pass.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, key).filter(F.spark_partition_id() >= 0) if len(rows.inputFiles()) < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    master (tests, one machine) gets a temporary folder once per application; on
    any other it is an error, as executors don't see the driver's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        made = getattr(spark.sparkContext, "_folio_folder", None)
        if made is None:
            made = "file://" + tempfile.mkdtemp(prefix="folio-")
            spark.sparkContext._folio_folder = made
        folder = made
    return folder.rstrip("/")


#: Has Spark delete the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that are run inside go with them."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and with it the shuffle files of the write.

    ``options`` are the writer's.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.options(**options).parquet(path)
    context = df.sparkSession.sparkContext
    context._folio_written = [*getattr(context, "_folio_written", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, by: str, **options: str) -> dict[int, DataFrame]:
    """``materialize`` with a table for each value of the whole number ``by``, a column they lack; each can be discarded alone."""
    spark = df.sparkSession
    context, path = spark.sparkContext, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.options(**options).partitionBy(by).parquet(path)
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in target.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(target) if f.isDirectory()]
    context._folio_written = [*getattr(context, "_folio_written", []), path, *(f"{path}/{x}" for x in names)]
    return {int(x.split("=")[1]): spark.read.schema(df.drop(by).schema).parquet(f"{path}/{x}") for x in names}


def discard(written: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    context = written.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0].removeprefix("file://") for f in written.inputFiles()}
    mine = [p for p in getattr(context, "_folio_written", []) if p.removeprefix("file://") in folders]
    context._folio_written = [p for p in getattr(context, "_folio_written", []) if p not in mine]
    delete(written.sparkSession, mine)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder."""
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def clear_intermediate(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written in this application; the number of them.

    To be called when results are written: frames that are still to be computed
    read them.
    """
    context = spark.sparkContext
    paths, context._folio_written = getattr(context, "_folio_written", []), []
    delete(spark, paths)
    return len(paths)


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
