"""Experiment planning: compute budgets, schedules and scaling arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Planner constants; fixed values.
BUDGETS = (1e17, 3e17, 1e18, 3e18, 1e19)
RATIOS = (5, 10, 20, 40, 60)
LARGE_BUDGET, LARGE_RATIO = 1e19, 20
SMALL_MODEL = 120_000_000
SMALL_BATCH, LARGE_BATCH = 262_144, 524_288
PEAK_FLOPS, UTILISATION = 989e12, 0.2


def tokens_for(flops: Column, params: Column) -> Column:
    return F.floor(flops / (F.lit(6.0) * params)).cast("long")


def batch_tokens(params: Column) -> Column:
    return F.when(params <= SMALL_MODEL, SMALL_BATCH).otherwise(LARGE_BATCH).cast("long")


def train_hours(params: Column, tokens: Column) -> Column:
    """Hours on one device, to one decimal, ties to even as Python rounds."""
    return F.bround(F.lit(6.0) * params.cast("double") * tokens.cast("double") / F.lit(PEAK_FLOPS * UTILISATION) / F.lit(3600.0), 1)


def isoflop_plan(spark: SparkSession) -> DataFrame:
    """Model sizes and token counts for every budget and ratio of tokens to parameters."""
    b = spark.createDataFrame([(float(x),) for x in BUDGETS], "flops_budget double")
    r = spark.createDataFrame([(float(x),) for x in RATIOS], "ratio double")
    # Two constant lists of five: a fixed grid.
    g = b.join(F.broadcast(r), (F.col("flops_budget") < LARGE_BUDGET) | (F.col("ratio") == LARGE_RATIO))
    n = F.floor(F.sqrt(F.col("flops_budget") / (F.lit(6.0) * F.col("ratio")))).cast("long")
    d = g.withColumn("model_size_params", n).withColumn("training_tokens", tokens_for(F.col("flops_budget"), F.col("model_size_params")))
    d = d.withColumn("tokens_per_param", F.expr("training_tokens div model_size_params")).withColumn("batch_size", batch_tokens(F.col("model_size_params")))
    return d.withColumn("iterations", F.expr("training_tokens div batch_size")).withColumn("train_hours", train_hours(F.col("model_size_params"), F.col("training_tokens")))


def plan_report(plan: DataFrame) -> DataFrame:
    """Experiments, token and parameter totals in millions, and hours per budget."""
    return plan.groupBy("flops_budget").agg(
        F.count("*").alias("experiments"),
        (F.sum("training_tokens") / 1e6).alias("tokens_m"),
        (F.max("model_size_params") / 1e6).alias("largest_m"),
        F.sum("train_hours").alias("hours"),
    )


def model_size(d_model: Column, d_ff: Column, layers: Column) -> Column:
    d, f, n = (x.cast("long") for x in (d_model, d_ff, layers))
    return (F.lit(4) * d * d + F.lit(3) * d * f) * n


def run_tokens(steps: Column, accumulation: Column) -> Column:
    return steps.cast("long") * F.lit(SMALL_BATCH) * accumulation.cast("long")


def cosine_rate(it: Column, most: float, least: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up, half a cosine down to ``least``, then ``least``."""
    x = it.cast("double")
    ratio = (x - warmup) / (cycle - warmup)
    return F.when(x < warmup, F.lit(most) * x / warmup).when(x > cycle, F.lit(least)).otherwise(F.lit(least) + (F.cos(F.lit(3.141592653589793) * ratio) + 1.0) * 0.5 * (most - least))


def stable_decay_rate(it: Column, most: float, least: float, warmup: int, stable: int, decay: int) -> Column:
    """Linear warm-up, a plateau, and a linear decay to ``least``."""
    x = it.cast("double")
    left = F.lit(1.0) - (x - (warmup + stable)) / decay
    return F.when(x < warmup, F.lit(most) * x / warmup).when(x < warmup + stable, F.lit(most)).when(x < warmup + stable + decay, F.lit(least) + F.lit(most - least) * left).otherwise(F.lit(least))


def warmup_steps(params: Column, tokens_per_step: Column) -> Column:
    return F.floor(params / tokens_per_step).cast("long")


def width_scales(df: DataFrame, base_hidden: float, base_filter: float) -> DataFrame:
    """Learning-rate scales of attention and feed-forward matrices by width."""
    return df.withColumn("attn_lr_scale", F.lit(base_hidden) / F.col("d_model")).withColumn("ffn_lr_scale", F.lit(base_filter) / F.col("d_ff"))


def drawn(seed: int, *cols: str) -> Column:
    """A uniform number of ``[0, 1)`` from the MD5 of a seed and key columns, the same on every engine and
    for every partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def search_params(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Random trial parameters to three significant digits: one uniform, two log-uniform."""

    def three(x: Column) -> Column:
        e = F.floor(F.log10(x))
        return F.round(x / F.pow(F.lit(10.0), e), 2) * F.pow(F.lit(10.0), e)

    def between(low: float, high: float, k: int) -> Column:
        return F.exp(F.log(F.lit(low)) + drawn(seed + k, "id") * (F.log(F.lit(high)) - F.log(F.lit(low))))

    return spark.range(n).select(
        F.col("id").alias("trial"),
        three(drawn(seed, "id") * 19 + 1).alias("embeddings_scale"),
        three(between(1e-4, 0.2, 1)).alias("init_std"),
        three(between(1e-4, 0.1, 2)).alias("lr"),
    )


def parameter_count(shapes: DataFrame, name: str = "name", elements: str = "numel", embedding: str = "embedding") -> DataFrame:
    """All parameters, and those without embeddings, of a table of names and element counts."""
    n = F.col(elements).cast("long")
    return shapes.agg(F.sum(n).alias("total"), F.sum(F.when(~F.contains(F.lower(name), F.lit(embedding)), n).otherwise(0)).alias("without_embeddings"))
