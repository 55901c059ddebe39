"""Composed pipelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from siltworks.functions import text as T
from siltworks.operators import dedup, filters, models, sampling
from siltworks.session import durable


def clean_documents(docs: DataFrame, languages: tuple[str, ...] = filters.LANGUAGES, identifier: PipelineModel | None = None) -> DataFrame:
    """Flatten, length, language, masks and quality rules.  The language is the stored ``lang``, exactly
    as the queries' SQL has it, or what ``identifier`` finds in the text; ``lang`` then holds that."""
    d = docs if identifier is not None else docs.where(F.col("lang").isin(*languages))
    d = T.once(d, text=T.flatten("text")).where(filters.long_enough(F.col("text")))
    if identifier is not None:
        d = T.once(models.predict(identifier, d, name="_id"), lang=F.col("_id.label")).where(F.col("lang").isin(*languages)).select(*docs.columns)
    return filters.quality_stats(T.once(d, text=T.mask_all("text"))).where("passes")


def judged(docs: DataFrame, judges: Sequence[tuple[PipelineModel, str]]) -> DataFrame:
    """Rows to which every classifier gives its wanted label."""
    d = docs
    for k, (model, _) in enumerate(judges):
        d = models.predict(model, d, name=f"_p{k}")
    keep = reduce(lambda a, b: a & b, (F.col(f"_p{k}.label") == label for k, (_, label) in enumerate(judges)))
    return T.once(d, _keep=keep).where("_keep").select(*docs.columns)


def crawl_pipeline(docs: DataFrame, file_col: str, identifier: PipelineModel, judges: Sequence[tuple[PipelineModel, str]]) -> DataFrame:
    """Cleaned documents, in a language that ``identifier`` finds, that get the wanted label of every classifier in ``judges`` and that do not
    repeat themselves, deduplicated by file and then over all."""
    d = durable(judged(clean_documents(docs, identifier=identifier), judges))
    rep = filters.repetition_stats(d).where("NOT repetitive").select("doc_id")
    return dedup.two_level_dedup(durable(d.join(rep, "doc_id", "left_semi")), file_col)


def stage_counts(stages: dict[str, DataFrame], file_col: str) -> DataFrame:
    """Documents after each stage per file."""
    out = None
    for name, d in stages.items():
        c = d.groupBy(file_col).agg(F.count("*").alias("docs")).withColumn("stage", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def classifier_samples(docs: DataFrame, label: str, file_col: str, most: int, files: int) -> DataFrame:
    """Label lines of clean documents under a quota per file."""
    d = sampling.file_quota(clean_documents(docs), file_col, ["doc_id"], most, files)
    return d.select("doc_id", T.label_line(F.lit(label), "text").alias("value"))


def budgeted_sample(docs: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """Non-empty documents in order within a budget."""
    return sampling.token_budget(docs.where("text IS NOT NULL AND text <> ''"), order, size, target)
