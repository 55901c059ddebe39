"""Problem 4: near-duplicate documents by PartEnum signatures (``operators/partenum.py``).

Exact copies are represented by their first id and come back at the end.

Defined results: null texts and texts under five words are in no pair; repeated rows of one id give
no pair with themselves; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.functions.normalize import normalize_one
from siltworks.llm.batches import map_columns
from siltworks.operators.dedup import components
from siltworks.operators.partenum import (  # noqa: F401
    _BLOCK,
    AT_ONCE,
    N,
    THRESHOLD,
    _agreeing,
    _blocks,
    _candidates,
    _hot_pairs,
    pairs_of,
    signatures,
    sketches,
)
from siltworks.session import durable


def copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, rep`` of every document whose text has exact copies, the first id being ``rep``."""
    h = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(text_col), 256).alias("h")).where("h IS NOT NULL")
    g = h.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    return durable(h.join(g, "h").select("id", "rep").distinct())


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b, jaccard`` between representatives of exact copies, and the copies' membership
    ``id, rep``."""
    member = copies(docs, id_col, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    reps = base.join(member.where("id <> rep").select("id"), "id", "left_anti")
    return pairs_of(base, reps, threshold), member


def found(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs, those of and between exact copies included."""
    exact, member = similar_pairs(docs, threshold)
    exact = durable(exact)
    ra, rb = (member.select(F.col("id").alias(f"m{x}"), F.col("rep").alias(x)) for x in "ab")
    a, b = F.coalesce("ma", "a"), F.coalesce("mb", "b")
    between = exact.join(ra, "a", "left").join(rb, "b", "left").select(F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b"))
    words = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").alias("t")).join(member.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    long_enough = map_columns(words, ["rep", "t"], "rep long, ok boolean", lambda i, t: [i, [len(normalize_one(x).split()) >= N for x in t]]).where("ok").select("rep")
    m = member.join(long_enough, "rep", "left_semi")
    within = m.select("rep", F.col("id").alias("doc_id_a")).join(m.select("rep", F.col("id").alias("doc_id_b")), "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return between.unionByName(within).distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id, links``: every document with five words or more that has a copy or a near
    copy; the least id of its class; and how many other texts its own text is similar to.  Copies have
    the links of the text they share, and are not paired with each other."""
    exact, member = similar_pairs(docs, threshold)
    pairs = durable(exact.select(F.col("a").alias("lo"), F.col("b").alias("hi")))
    ends = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    words = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").alias("t")).join(member.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    long_enough = map_columns(words, ["rep", "t"], "rep long, ok boolean", lambda i, t: [i, [len(normalize_one(x).split()) >= N for x in t]]).where("ok").select("rep")
    copied = durable(member.join(long_enough, "rep", "left_semi"))
    texts = ends.select("id").unionByName(copied.select(F.col("rep").alias("id"))).distinct()
    of = components(texts, pairs).join(ends, "id", "left").select(F.col("id").alias("rep"), F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    every = copied.select("id", "rep").unionByName(ends.select("id", F.col("id").alias("rep"))).distinct()
    return every.join(of, "rep").select(F.col("id").alias("doc_id"), "group_id", "links")
