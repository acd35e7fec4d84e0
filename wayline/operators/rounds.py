"""Tables between the rounds of an iteration: written to the shared folder and read again, so plans stay short and lost executors
cost a round at most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.graphs import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table. The shuffle files of the step are deleted when it ends, for nothing reads them again."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/rounds/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for df in tables:
        if df is not None:
            sc = df.sparkSession.sparkContext
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
