"""Text classifiers: training, relational scoring and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions import text as T

#: Most rows used to fit a classifier.
TRAIN_ROWS = 20_000


def one_line(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.replace(c, F.lit("\n"), F.lit(" "))


def train_text_classifier(rows: DataFrame, label: str = "label", text: str = "text", seed: int = 42) -> PipelineModel:
    """Words and word pairs, hashed, with logistic regression, on at most ``TRAIN_ROWS`` rows."""
    data = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label), one_line(text).alias(text)).orderBy(F.md5(text)).limit(TRAIN_ROWS)
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label_ix", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"\s+"),
            NGram(n=2, inputCol="w1", outputCol="w2"),
            HashingTF(inputCol="w1", outputCol="h1", numFeatures=1 << 15, binary=True),
            HashingTF(inputCol="w2", outputCol="h2", numFeatures=1 << 16, binary=True),
            VectorAssembler(inputCols=["h1", "h2"], outputCol="features"),
            LogisticRegression(labelCol="label_ix", maxIter=20, regParam=1e-3),
        ]
    ).fit(data)


def train_language_id(rows: DataFrame, label: str = "lang", text: str = "text") -> PipelineModel:
    """Character trigrams, hashed, with naive Bayes, on at most ``TRAIN_ROWS`` rows."""
    chars = F.expr(f"regexp_replace(lower({text}), '(?s)(.)', '$1 ')")
    data = rows.where(F.col(label).isNotNull() & (F.length(text) > 20)).select(label, chars.alias("c")).orderBy(F.md5("c")).limit(TRAIN_ROWS)
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label_ix", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol="c", outputCol="w1", pattern=" ", minTokenLength=1),
            NGram(n=3, inputCol="w1", outputCol="w3"),
            HashingTF(inputCol="w3", outputCol="features", numFeatures=1 << 15),
            NaiveBayes(labelCol="label_ix", smoothing=0.5),
        ]
    ).fit(data)


def predict(model: PipelineModel, df: DataFrame, text: str = "text", name: str = "pred") -> DataFrame:
    """Adds a struct of the best label and its probability; rows without text are left out."""
    labels = model.stages[0].labels
    by_character = isinstance(model.stages[-1], NaiveBayesModel)
    src = df.withColumn("c", F.expr(f"regexp_replace(lower({text}), '(?s)(.)', '$1 ')")) if by_character else df.withColumn(text, one_line(text))
    stages = PipelineModel(model.stages[1:])
    out = stages.transform(src.where(F.col(text).isNotNull()))
    p = vector_to_array("probability")
    k = F.array_position(p, F.array_max(p)).cast("int")
    return out.withColumn(name, F.struct(F.element_at(F.array(*[F.lit(x) for x in labels]), k).alias("label"), F.array_max(p).alias("score"))).select(*df.columns, name)


def linear_score(df: DataFrame, weights: DataFrame, bias: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score``: the logistic of summed token weights; documents without known tokens score
    the bias."""
    toks = df.select(id_col, F.explode(T.words(F.lower(text))).alias("token"))
    s = toks.join(weights, "token").groupBy(id_col).agg(F.sum("w").alias("s"))
    return df.select(id_col).join(s, id_col, "left").select(id_col, (1.0 / (1.0 + F.exp(-(F.coalesce("s", F.lit(0.0)) + bias)))).alias("score"))


def evaluate(predictions: DataFrame, truth: str, pred: str) -> DataFrame:
    """Number of samples and share of correct labels."""
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("precision_at_1"))


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted classifier; a folder that exists is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
