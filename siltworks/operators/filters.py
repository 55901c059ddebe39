"""Row filters and per-document quality statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions import text as T
from siltworks.functions.normalize import normalize_text

MAX_PAYLOAD = 100_000_000
MIN_CHARS = 100
LANGUAGES = ("en", "zh")
# Limits of the web-text quality rules; fixed values.
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN, MAX_MEAN = 3.0, 10.0
MAX_ELLIPSIS, MIN_ALPHA = 0.3, 0.8


def records(df: DataFrame, kind: str, payload: str = "payload", type_col: str = "warc_type") -> DataFrame:
    """Records of one type with a payload that is not too large."""
    return df.where((F.col(type_col) == kind) & (F.octet_length(payload) <= MAX_PAYLOAD))


def decode_utf8(x: Column | str) -> Column:
    """Bytes as UTF-8 with replacement characters."""
    c = F.col(x) if isinstance(x, str) else x
    return F.make_valid_utf8(c.cast("string"))


def long_enough(x: Column, least: int = MIN_CHARS) -> Column:
    return F.length(x) >= least


def quality_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, mean_word_len, ellipsis_frac, alpha_frac, passes, reason``.

    The reason is the first rule that fails; empty texts fail the first.  Limits themselves pass.
    """
    d = T.once(df, _w=T.words(text), _l=F.split(F.col(text), "\n"))
    n = F.size("_w").cast("long")
    chars = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    d = T.once(
        d,
        n_words=n,
        mean_word_len=F.try_divide(chars.cast("double"), n.cast("double")),
        ellipsis_frac=F.size(F.filter("_l", lambda x: F.endswith(x, F.lit("...")))).cast("double") / F.size("_l").cast("double"),
        alpha_frac=F.try_divide(F.size(F.filter("_w", lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))).cast("double"), n.cast("double")),
    ).drop("_w", "_l")
    reason = (
        F.when(F.col("n_words") < MIN_WORDS, "few_words")
        .when(F.col("n_words") > MAX_WORDS, "many_words")
        .when(~F.col("mean_word_len").between(MIN_MEAN, MAX_MEAN), "word_length")
        .when(F.col("ellipsis_frac") > MAX_ELLIPSIS, "ellipsis")
        .when(F.col("alpha_frac") < MIN_ALPHA, "alphabetic")
    )
    return d.withColumn("reason", reason).withColumn("passes", F.col("reason").isNull() & F.col("n_words").isNotNull())


def repetition_stats(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 3, threshold: float = 0.3) -> DataFrame:
    """``id, total, distinct_n, max_freq, repetitive`` per row, from its word ``n``-grams.

    A document's sequences are counted within its row, by runs in sorted order, without a shuffle.
    Texts under ten normalised characters, or without ``n``-grams, are not repetitive.
    """
    norm = df.select(F.col(id_col), normalize_text(text).alias("_n"))
    d = T.once(norm, _len=F.length("_n"), _g=F.array_sort(T.ngrams(F.filter(F.split("_n", " "), lambda w: w != ""), n)))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), zero.alias("run"), zero.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    j = T.once(d, total=F.size("_g").cast("long"), distinct_n=F.size(F.array_distinct("_g")).cast("long"), max_freq=F.aggregate("_g", start, step, lambda a: a["best"]))
    flag = (F.col("_len") >= 10) & (F.col("total") > 0) & (
        (F.try_divide(F.col("distinct_n").cast("double"), F.col("total").cast("double")) < F.lit(1.0) - F.lit(threshold))
        | (F.try_divide(F.col("max_freq").cast("double"), F.col("total").cast("double")) > F.lit(threshold))
    )
    return j.select(id_col, "total", "distinct_n", "max_freq", F.coalesce(flag, F.lit(False)).alias("repetitive"))
