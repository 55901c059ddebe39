"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import garbled, language, mixing, packing, partenum, personal, prose, reading, toxic, wrappers
from siltworks.plans import catalog
from siltworks.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.found(table(spark, sf, "documents"), table(spark, sf, "pages"))


@query
def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled documents with their restored text."""
    docs = table(spark, sf, "documents")
    model, margin = garbled.train_model(docs, table(spark, sf, "pages"))
    return garbled.repair_documents(docs, model, margin).where("garbled").select("doc_id", "restored")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return prose.found(table(spark, sf, "documents"))


@query
def p1_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics, verdict and reasons of every document."""
    return prose.text_stats(table(spark, sf, "documents"))


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.found(table(spark, sf, "documents"))


@query
def p2_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language, confidence and single-language stretches of every document."""
    docs = table(spark, sf, "documents")
    return language.detect(docs, language.train(docs)).select("doc_id", "lang", "confidence", "langs", "segments")


# Every pair that shares a sequence, counted by a plain join: fit for small tables only.
SQL["p4_found"] = f"""WITH e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM {catalog._SETS} WHERE len(s) > 0),
 i AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
 SELECT doc_id_a, doc_id_b FROM i WHERE i::DOUBLE / (na + nb - i)::DOUBLE >= 0.8"""


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return partenum.found(table(spark, sf, "documents"))


# Classes of the SQL above: equal texts are one vertex, and links are counted between texts.
SQL["p4_groups"] = f"""WITH RECURSIVE p AS ({SQL["p4_found"]}),
 t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL),
 v AS (SELECT doc_id_a AS doc_id FROM p UNION SELECT doc_id_b FROM p),
 q AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM p JOIN t a ON p.doc_id_a = a.doc_id JOIN t b ON p.doc_id_b = b.doc_id WHERE a.rep <> b.rep),
 e2 AS (SELECT x, y FROM q UNION SELECT y, x FROM q),
 r AS (SELECT DISTINCT rep AS x, rep AS root FROM t JOIN v USING (doc_id) UNION SELECT e2.y, r.root FROM r JOIN e2 ON r.x = e2.x),
 c AS (SELECT x, min(root) AS group_id FROM r GROUP BY x),
 n AS (SELECT x, count(*) AS links FROM e2 GROUP BY x)
 SELECT v.doc_id, c.group_id, coalesce(n.links, 0)::BIGINT AS links FROM v JOIN t USING (doc_id) JOIN c ON t.rep = c.x LEFT JOIN n ON t.rep = n.x"""


@query
def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every document with copies or near copies, and its number of similar texts."""
    return partenum.groups(table(spark, sf, "documents"))


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return toxic.found(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents per source."""
    docs = table(spark, sf, "documents")
    return toxic.rates(docs, toxic.train(docs, table(spark, sf, "labels")))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.found(table(spark, sf, "documents"))


@query
def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with items, masked by typed placeholders and pseudonyms."""
    return personal.detect(table(spark, sf, "documents"), personal.session_key(spark)).where("size(items) > 0").select("doc_id", "masked")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.found(table(spark, sf, "pages"))


@query
def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every piece of every document, for each container size."""
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_specs"))


@query
def p8_fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_rates(packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_specs")))


@query
def p9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of every document in each mix."""
    return mixing.rates(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).select("mix_name", "doc_id", "source", "n_tokens", "repeats")


@query
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.rates(table(spark, sf, "documents"), targets), targets)


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.found(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Reading levels per source."""
    return reading.profile(table(spark, sf, "documents"), table(spark, sf, "labels"))
