"""Ordered scans over whole tables without a single-partition window.

Rows are range-partitioned by the order, each partition is summed on its own, and the few partition
totals give every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.session import durable


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str = "total_before") -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one; ``order`` must be unique."""
    d = durable(df.withColumn("_v", value.cast("long")).repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    per = d.groupBy("_p").agg(F.sum("_v").alias("_s"))
    # One row per partition: a window over partition totals, not over the data.
    off = per.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(off), "_p").withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(w), F.lit(0))).drop("_v", "_o", "_p")


def row_number(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Adds the global row number from 1."""
    return running_total(df, order, F.lit(1), "_b").withColumn(name, F.col("_b") + 1).drop("_b")


def greedy_shards(df: DataFrame, order: Sequence[str], size: str, limit: int, name: str = "shard") -> DataFrame:
    """Adds the number of the shard of each row: rows fill a shard until its total reaches ``limit``,
    the row that reaches it included; then the next begins at zero.

    Cuts depend on all earlier rows, so partitions are walked in order, but each step only reads the
    files of one partition, searches its prefix sums and hands on one number: all steps together read
    the table once.
    """
    d = running_total(df, order, F.col(size), "_before")
    d = durable(d.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), partition_by="_p")
    spark = df.sparkSession
    begin, shards = 0, 0
    rows = []
    for (p,) in d.select("_p").distinct().orderBy("_p").collect():

        def walk(batches, begin=begin, shards=shards):
            ends = np.sort(np.concatenate([b.column(0).to_numpy() for b in batches if b.num_rows] or [np.zeros(0, np.int64)]))
            cuts, b = [], begin
            while True:
                i = int(np.searchsorted(ends, b + limit, side="left"))
                if i >= len(ends):
                    break
                b = int(ends[i])
                cuts.append(b)
            yield pa.RecordBatch.from_pydict({"cuts": [cuts]}, schema=pa.schema([("cuts", pa.list_(pa.int64()))]))

        # The walk of one partition needs its rows together: one task of one partition's size.
        part = d.where(F.col("_p") == p).select((F.col("_before") + F.col(size)).cast("long").alias("e")).coalesce(1)
        cuts = [c for r in part.mapInArrow(walk, "cuts array<long>").collect() for c in r.cuts]
        rows.append((p, shards, cuts))
        begin, shards = (cuts[-1] if cuts else begin), shards + len(cuts)
    t = spark.createDataFrame(rows, "_p int, _base long, _cuts array<long>")
    done = F.size(F.filter("_cuts", lambda c: c <= F.col("_before")))
    return d.join(t, "_p").withColumn(name, F.col("_base") + done).drop("_p", "_base", "_cuts", "_before")
