"""Tables in the shared folder, where a plan's lineage is cut so that lost executors cost little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where set while a table is written, its shuffle files go when the write ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and all runs on this machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        import tempfile

        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that lineage ends here.

    ``large_rows``: rows of megabytes, so the writer looks at its memory after each of them.
    """
    options = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(32 << 20), "compression": "zstd"} if large_rows else {}
    return _written(df, name, options)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for narrow rows in great numbers: whole numbers as differences, and no shuffle file outlives the write."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return _written(df, name, {"parquet.writer.version": "v2", "compression": "zstd"})
    finally:
        conf.set(CLEANUP, before)


def _written(df: DataFrame, name: str, options: dict) -> DataFrame:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that were stored and that no plan will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
