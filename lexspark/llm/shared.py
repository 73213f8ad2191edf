"""Helpers that several operators use: shared scratch tables, table reading, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the whole cluster shares (``spark.checkpoint.dir``).

    A machine-local folder is chosen only where that setting is missing in a local session, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks it ran, and a table that is
    used twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_turns(spark: SparkSession, turns: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """The rows of all ``turns``, each written to the shared folder before the next one is made.

    The result is one table of files, so its plan and what the driver holds don't grow with the number of
    turns, and a lost executor costs no turn that is written. No turns give an empty table.
    """
    path, n = scratch_path(spark, name), 0
    empty = spark.createDataFrame([], schema)
    for n, rows in enumerate(turns, 1):
        rows.select(*empty.columns).write.parquet(f"{path}/turn={n}")
    return spark.read.schema(empty.schema).parquet(path).select(*empty.columns) if n else empty


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_sum(df: DataFrame, order: list[str], value: str, group: str | None, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``, within ``group``.

    Rows are dealt by range, so one group may spread over many tasks. Each task sums its own sorted
    rows; the totals by task and group (a few rows for each task) are then summed and added. ``df``
    should be narrow and already materialised, because the range sampling reads it twice.
    """
    keys = ([group] if group else []) + order
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())]
    )
    names = [f.name for f in schema.fields]

    def sums(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total, first = None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(value).to_pandas().fillna(0).astype("int64")
            if group:
                label = b.column(group).to_pandas()
                label = label.where(label.notna(), None)
                fresh = label.ne(label.shift()) & ~(label.isna() & label.shift().isna())
                fresh.iloc[0] = first or not (label.iloc[0] == last or (label.iloc[0] is None and last is None))
                last = label.iloc[-1]
            else:
                fresh = pd.Series(False, index=size.index)
                fresh.iloc[0] = first
            run = fresh.cumsum()
            upto = size.groupby(run).cumsum()
            upto = upto.where(run > 0, upto + total)
            total = int(upto.iloc[-1])
            first = False
            cols = [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(upto - size, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = materialise(dealt.mapInArrow(sums, schema), "sums")
    by = ["_part"] + ([group] if group else [])
    totals = local.groupBy(*by).agg(F.max(F.col("_before") + F.coalesce(F.col(value), F.lit(0))).alias("_total"))
    from pyspark.sql import Window

    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(w), F.lit(0))).drop("_total")
    offset = offset.select(F.col("_part").alias("_p"), *([F.col(group).alias("_g")] if group else []), "_offset")
    on = F.col("_part") == F.col("_p")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_g"))
    joined = local.join(offset, on, "left")
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.col("_offset"), F.lit(0))).select(
        *df.columns, out
    )
