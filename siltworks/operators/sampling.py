"""Budgets, quotas, splits and interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.operators.ordered import row_number, running_total


def seeded(seed: int, *cols: str) -> Column:
    """A pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def token_budget(df: DataFrame, order: Sequence[str], size: str, target: int) -> DataFrame:
    """Rows in order until the total reaches ``target``; the row that reaches it is kept."""
    return running_total(df, order, F.col(size), "total_before").where(F.col("total_before") < target)


def group_budget(df: DataFrame, group: str, order: Sequence[str], size: str, target: int, groups: int) -> DataFrame:
    """As :func:`token_budget`, with ``target // groups`` for each group."""
    d = running_total(df, [group, *order], F.col(size), "_all")
    first = d.groupBy(group).agg(F.min("_all").alias("_from"))
    return (
        d.join(first, group)
        .withColumn("total_before", F.col("_all") - F.col("_from"))
        .where(F.col("total_before") < target // groups)
        .drop("_all", "_from")
    )


def top_per_group(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes them before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def file_quota(df: DataFrame, group: str, order: Sequence[str], most: int, files: int) -> DataFrame:
    """``most // files`` rows of each file, one more of the first ``most % files`` files."""
    w = Window.partitionBy(group).orderBy(*order)
    # One row per file.
    rank = df.select(group).distinct().withColumn("file_no", F.row_number().over(Window.orderBy(group)))
    q = F.lit(most // files) + F.when(F.col("file_no") <= most % files, 1).otherwise(0)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most // files + 1).join(rank, group).where(F.col("rn") <= q)


def exact_split(df: DataFrame, key: str, fraction_percent: int = 90, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ``int(n * fraction)`` rows in seeded order train, the rest validate."""
    n = df.count()
    d = row_number(df.withColumn("_h", seeded(seed, key)), ["_h", key], "_rn")
    return d.withColumn("split", F.when(F.col("_rn") <= n * fraction_percent // 100, "train").otherwise("valid")).drop("_h", "_rn")


def random_k(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement: a top-k by seeded order, not a full sort."""
    return df.orderBy(seeded(seed, key), F.col(key)).limit(k)


def round_robin(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``turn``: the groups in order of name take turns, each with its next row."""
    d = row_number(df, [group, *order], "_g")
    first = d.groupBy(group).agg(F.min("_g").alias("_f"))
    return d.join(first, group).withColumn("turn", F.col("_g") - F.col("_f")).drop("_g", "_f")


def batch_number(df: DataFrame, order: Sequence[str], rows: int = 10_000) -> DataFrame:
    return row_number(df, order, "_rn").withColumn("batch_id", F.floor((F.col("_rn") - 1) / rows).cast("long")).drop("_rn")


def interleaved_budget(df: DataFrame, group: str, order: Sequence[str], size: str, target: int) -> DataFrame:
    """Groups take turns, row by row, until the total reaches ``target``; the crossing row is kept."""
    return token_budget(round_robin(df, group, order), ["turn", group], size, target)


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def line_chunks(df: DataFrame, order: Sequence[str], chunks: int = 16, name: str = "chunk") -> DataFrame:
    """Adds the number from 0 of each row's chunk: rows in order, in chunks whose sizes differ by one at most."""
    n = df.count()
    return row_number(df, order, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) * chunks / max(1, n)).cast("int")).drop("_rn")


def first_rows(df: DataFrame, order: Sequence[str], n: int = 21) -> DataFrame:
    """The first rows of an order, as a demonstration run takes them."""
    return df.orderBy(*order).limit(n)
