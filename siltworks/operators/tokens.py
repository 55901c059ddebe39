"""Token streams, training windows and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.functions import text as T
from siltworks.operators.ordered import row_number, running_total


def word_ids(x: str = "text", vocabulary: int = 50_257) -> "F.Column":
    """A deterministic stand-in tokenizer on the JVM: one id per word, from the word's MD5."""
    return F.transform(T.words(x), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary)


def encode(df: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]], id_col: str = "doc_id", text: str = "text", max_length: int | None = None) -> DataFrame:
    """``id, tokens`` by a pluggable tokenizer in Arrow batches; empty texts are skipped and long
    token lists cut at ``max_length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int32()))])
        for b in batches:
            rows = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and t.strip()]
            toks = tokenizer([t for _, t in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([k[:max_length] if max_length else k for k in toks], pa.list_(pa.int32()))], schema=schema
            )

    return df.select(F.col(id_col).cast("long"), text).mapInArrow(run, "id long, tokens array<int>")


def token_bytes(tokens: str = "tokens") -> "F.Column":
    return (F.size(tokens) * 2).cast("long")


def stream_positions(df: DataFrame, order: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Adds ``offset``, the position of the row's first token in the concatenated stream."""
    return running_total(df, order, F.size(tokens), "offset")


def eval_windows(df: DataFrame, context: int, tokens: str = "tokens") -> DataFrame:
    """One row per window of each sequence: ``x`` of ``context`` tokens and ``y`` one further on.
    Sequences not longer than the context give none."""
    n = F.size(tokens)
    starts = F.when(n > context, F.sequence(F.lit(0), n - context - 1, F.lit(context)))
    d = df.withColumn("start", F.explode(starts))
    return d.withColumn("x", F.slice(tokens, F.col("start") + 1, context)).withColumn("y", F.slice(tokens, F.col("start") + 2, context)).drop(tokens)


def batches(df: DataFrame, order: Sequence[str], size: int, most: int | None = None) -> DataFrame:
    """Adds ``batch``; the last may be short, and at most ``most`` batches are kept."""
    d = row_number(df, order, "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
    return d if most is None else d.where(F.col("batch") < most)


def rank_stripe(df: DataFrame, order: Sequence[str], rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank``."""
    return row_number(df, order, "_rn").where(F.pmod(F.col("_rn") - 1, F.lit(world)) == rank).drop("_rn")


def train_draws(df: DataFrame, seed: int, file_col: str = "doc_id") -> DataFrame:
    """Adds ``arrival``, whose order draws windows uniformly over the files that are not exhausted,
    each file from its first window on.

    Every file's windows arrive after independent exponential gaps, seeded by file and window; the
    next arrival then comes from each unfinished file with equal chance, and no global loop is needed.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(file_col).cast("string"), F.col("start").cast("string"))), 1, 8), 16, 10).cast("double")
    gap = -F.log((h + 0.5) / F.lit(4294967296.0))
    w = Window.partitionBy(file_col).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("arrival", F.sum(gap).over(w))


def random_windows(df: DataFrame, context: int, seed: int, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """One seeded window per sequence that is longer than the context."""
    n = F.size(tokens)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    d = df.where(n > context).withColumn("start", (h % (n - context)).cast("int"))
    return d.withColumn("x", F.slice(tokens, F.col("start") + 1, context)).withColumn("y", F.slice(tokens, F.col("start") + 2, context)).drop(tokens)
