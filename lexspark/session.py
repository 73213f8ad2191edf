"""Cutting of lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is not set in a local session, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` wrote, once nothing reads them any more."""
    for table in tables:
        session = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path.rpartition("/")[2].startswith("cut-"):
                at = session._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)
