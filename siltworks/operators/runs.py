"""Training-run logs: parsing, smoothing, summaries and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Patterns of the training scripts' output; fixed values.
TRAIN_LOSS = r"Training step [0-9]+, Loss: ([0-9\.eE+-]+)"
SMOOTHED_LOSS = r"Training step [0-9]+, Loss: [0-9\.eE+-]+, Smoothed Loss: ([0-9\.eE+-]+)"
VALID_LOSS = r"Final estimated validation loss: ([0-9\.eE+-]+)"

# A step line as one pattern: the step ends the first field, the others are named values.
_STEP_LINE = r"^Training step(?:[^,\]]* )?([^ ,\]]+)" + r", [^,\]]*?: ([^,:\]]+)" * 3


def parse_log(df: DataFrame, line: str = "line") -> DataFrame:
    """``step, train_loss, smoothed_loss, lr`` of lines that begin with ``Training step`` and hold
    four well-formed fields; other lines are left out."""
    rest = [c for c in df.columns if c != line]
    out = df.select(
        *rest,
        *(
            F.regexp_extract(F.trim(F.col(line)), _STEP_LINE, k + 1).try_cast(kind).alias(name)
            for k, (name, kind) in enumerate((("step", "bigint"), ("train_loss", "double"), ("smoothed_loss", "double"), ("lr", "double")))
        ),
    )
    return out.where("step IS NOT NULL AND train_loss IS NOT NULL AND smoothed_loss IS NOT NULL AND lr IS NOT NULL")


def last_match(x: Column | str, pattern: str) -> Column:
    """The first group of the pattern's last match, as a number; null without one."""
    c = F.col(x) if isinstance(x, str) else x
    clean = F.replace(c, F.lit("\r"), F.lit("\n"))
    return F.try_element_at(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")


def distinct_steps(history: DataFrame) -> DataFrame:
    """One row per run and step: the one logged first, ties by the losses and the rate."""
    w = Window.partitionBy("run_id", "step").orderBy(*[F.col(c).asc_nulls_last() for c in ("logged_at", "train_loss", "eval_loss", "smoothed_loss", "lr")])
    return history.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trailing_mean(history: DataFrame, value: str = "train_loss", width: int = 10) -> DataFrame:
    """Adds the mean of the last ``width`` non-null values of the run."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(-(width - 1), 0)
    return history.withColumn("trailing", F.avg(value).over(w))


def summary(history: DataFrame) -> DataFrame:
    """Steps, first and last values and minima per run."""
    return history.groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.min("train_loss").alias("min_train_loss"),
        F.max_by("train_loss", "step").alias("final_train_loss"),
        F.min("smoothed_loss").alias("min_smoothed_loss"),
        F.min("eval_loss").alias("min_eval_loss"),
        F.max_by("eval_loss", F.when(F.col("eval_loss").isNotNull(), F.col("step"))).alias("final_eval_loss"),
        F.min_by("lr", "step").alias("initial_lr"),
        F.max_by("lr", "step").alias("final_lr"),
    )


def left_join_eval(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Train rows with the evaluation of the same step, if any."""
    return train.join(evaluation, ["run_id", "step"], "left")

