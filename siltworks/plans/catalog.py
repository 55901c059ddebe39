"""The core queries, each with the SQL that DuckDB runs on the same tables where SQL can express it.

Queries without SQL: those whose rows come from HTML parsing, byte decoding, trained classifiers,
canonical decomposition of characters, or hash families of our own; tests compare them with plain
restatements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions import html, text as T
from siltworks.functions.normalize import normalize_text
from siltworks.operators import dedup, filters, models, ordered, planning, runs, sampling, tokens
from siltworks.plans import pipeline
from siltworks.sources import files
from siltworks.session import durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = T.WS
_STRIP = f"'^{WS}+|{WS}+$'"
_FLAT = f"regexp_replace(replace(text, chr(10), ' '), {_STRIP}, '', 'g')"
_EMAIL, _PHONE, _IP = f"'{T.EMAIL}'", f"'{T.PHONE}'", f"'{T.IPV4}'"


def _masked(x: str) -> str:
    for p, m in ((_EMAIL, T.EMAIL_MASK), (_PHONE, T.PHONE_MASK), (_IP, T.IP_MASK)):
        x = f"regexp_replace({x}, {p}, '{m}', 'g')"
    return x


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


_ORDER_TOTAL = "coalesce(sum({v}) OVER (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- text projections and filters ---

_GOPHER = """
 n_words, mean_word_len, ellipsis_frac, alpha_frac,
 CASE WHEN n_words < 50 THEN 'few_words' WHEN n_words > 100000 THEN 'many_words' WHEN NOT (mean_word_len BETWEEN 3.0 AND 10.0) THEN 'word_length'
      WHEN ellipsis_frac > 0.3 THEN 'ellipsis' WHEN alpha_frac < 0.8 THEN 'alphabetic' END AS reason"""


def _gopher(src: str, where: str = "") -> str:
    return f"""WITH w AS (SELECT doc_id, lang, text, {_words('text')} AS ws, string_split(text, chr(10)) AS ls FROM ({src})),
 s AS (SELECT doc_id, lang, text, len(ws)::BIGINT AS n_words,
   CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws)::DOUBLE END AS mean_word_len,
   len(list_filter(ls, lambda x: ends_with(x, '...')))::DOUBLE / len(ls)::DOUBLE AS ellipsis_frac,
   CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: regexp_full_match(x, '\\p{{L}}+')))::DOUBLE / len(ws)::DOUBLE END AS alpha_frac FROM w),
 g AS (SELECT doc_id, lang, text, {_GOPHER} FROM s) """


@query(
    _gopher(f"SELECT doc_id, lang, {_masked(_FLAT)} AS text FROM documents WHERE lang IN ('en', 'zh') AND length({_FLAT}) >= 100")
    + "SELECT doc_id, lang, text, n_words FROM g WHERE reason IS NULL AND n_words IS NOT NULL"
)
def flagship_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.clean_documents(docs(spark, sf).select("doc_id", "lang", "text")).select("doc_id", "lang", "text", "n_words")


@query(f"SELECT doc_id, {_FLAT} AS flat FROM documents")
def flatten_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.flatten("text").alias("flat"))


@query(f"SELECT doc_id FROM documents WHERE length({_FLAT}) >= 100")
def min_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where(filters.long_enough(T.flatten("text"))).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'zh')")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where(F.col("lang").isin(*filters.LANGUAGES)).select("doc_id", "lang")


def _mask_query(name: str, pattern: str, holder: str) -> None:
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        masked, n = T.mask("text", pattern, holder)
        return docs(spark, sf).select("doc_id", masked.alias("masked"), n.cast("long").alias("n"))

    fn.__name__ = name
    query(f"SELECT doc_id, regexp_replace(text, '{pattern}', '{holder}', 'g') AS masked, len(regexp_extract_all(text, '{pattern}'))::BIGINT AS n FROM documents")(fn)


_mask_query("mask_emails", T.EMAIL, T.EMAIL_MASK)
_mask_query("mask_phones", T.PHONE, T.PHONE_MASK)
_mask_query("mask_ips", T.IPV4, T.IP_MASK)


@query(f"SELECT doc_id, {_masked('text')} AS masked FROM documents")
def mask_all(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.mask_all("text").alias("masked"))


@query(_gopher("SELECT doc_id, lang, text FROM documents") + "SELECT doc_id, n_words, round(mean_word_len, 9) AS mean_word_len, round(ellipsis_frac, 9) AS ellipsis_frac, round(alpha_frac, 9) AS alpha_frac, reason FROM g")
def gopher_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return filters.quality_stats(docs(spark, sf).select("doc_id", "text")).select(
        "doc_id", F.when(F.col("text").isNotNull(), F.col("n_words")).alias("n_words"), r("mean_word_len"), r("ellipsis_frac"), r("alpha_frac"), F.when(F.col("text").isNotNull(), F.col("reason")).alias("reason")
    )


@query(_gopher("SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL") + "SELECT doc_id FROM g WHERE reason IS NULL")
def gopher_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.quality_stats(docs(spark, sf).select("doc_id", "text").where("text IS NOT NULL")).where("passes").select("doc_id")


@query(_gopher(f"SELECT doc_id, lang, {_FLAT} AS text FROM documents WHERE text IS NOT NULL") + "SELECT doc_id, reason FROM g")
def gopher_flattened(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).where("text IS NOT NULL").select("doc_id", T.flatten("text").alias("text"))
    return filters.quality_stats(d).select("doc_id", "reason")


_NORM = f"trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}]', ' ', 'g'), '{WS}+', ' ', 'g'))"
_NW = f"(SELECT doc_id, {_NORM} AS t, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS ws FROM documents)"


def _grams(n: int) -> str:
    return f"CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) ELSE [] END"


_SETS = f"(SELECT doc_id, list_sort(list_distinct({_grams(5)})) AS s FROM {_NW})"
_CLASSES = f"(SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS rep FROM {_SETS} WHERE s IS NOT NULL)"
_PAIRS = f"""(WITH c AS (SELECT doc_id, s FROM {_CLASSES} WHERE doc_id = rep AND len(s) > 0), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM c),
 i AS (SELECT a.doc_id AS lo, b.doc_id AS hi, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
 SELECT lo, hi, i::DOUBLE / (na + nb - i)::DOUBLE AS jaccard FROM i WHERE i::DOUBLE / (na + nb - i)::DOUBLE >= 0.8)"""
_REP = f"""WITH g AS (SELECT doc_id, length(t) AS l, {_grams(3)} AS gs FROM {_NW}), e AS (SELECT doc_id, unnest(gs) AS g FROM g), c AS (SELECT doc_id, g, count(*) AS c FROM e GROUP BY ALL),
 p AS (SELECT doc_id, sum(c)::BIGINT AS total, count(*)::BIGINT AS distinct_n, max(c)::BIGINT AS max_freq FROM c GROUP BY doc_id),
 r AS (SELECT g.doc_id, coalesce(total, 0) AS total, coalesce(distinct_n, 0) AS distinct_n, coalesce(max_freq, 0) AS max_freq,
  coalesce(l >= 10 AND total > 0 AND (distinct_n::DOUBLE / total < 1.0::DOUBLE - 0.3::DOUBLE OR max_freq::DOUBLE / total > 0.3::DOUBLE), false) AS repetitive FROM g LEFT JOIN p ON g.doc_id = p.doc_id) """
_MIN = f"""(SELECT doc_id AS id, seed, min(md5(seed::VARCHAR || ':' || g)) AS value FROM (SELECT doc_id, unnest(s) AS g FROM {_SETS}), (SELECT unnest(range(8))::INTEGER AS seed) GROUP BY ALL)"""
_COMP = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT lo, hi FROM {_PAIRS}), b AS (SELECT lo AS u, hi AS v FROM p UNION SELECT hi, lo FROM p),
 r AS (SELECT u, u AS v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u), k AS (SELECT u, min(v) AS m FROM r GROUP BY u),
 c AS (SELECT d.doc_id, coalesce(k.m, d.rep) AS component FROM (SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY coalesce(s, []::VARCHAR[])), doc_id) AS rep FROM {_SETS}) d LEFT JOIN k ON d.rep = k.u) """


@query(f"SELECT doc_id, {_NORM} AS normalized FROM documents")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", normalize_text("text").alias("normalized"))


@query(
    f"""WITH w AS (SELECT doc_id, {_words('lower(text)')} AS ws FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, len(ws)::BIGINT AS n_words, greatest(len(ws) - 2, 0)::BIGINT AS n_grams,
  CASE WHEN len(ws) >= 3 THEN len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')))) ELSE 0 END::BIGINT AS n_distinct FROM w"""
)
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    w = docs(spark, sf).where("text IS NOT NULL").select("doc_id", T.words(F.lower("text")).alias("ws"))
    g = w.select("doc_id", F.size("ws").cast("long").alias("n_words"), T.ngrams(F.col("ws"), 3).alias("g"))
    return g.select("doc_id", "n_words", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


@query(_REP + "SELECT * FROM r")
def repetition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return filters.repetition_stats(docs(spark, sf))


@query(_REP + "SELECT doc_id FROM r WHERE NOT repetitive")
def repetition_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.repetition_stats(docs(spark, sf)).where("NOT repetitive").select("doc_id")


@query("SELECT model, replace(label, '__label__', '') AS label, count(*)::BIGINT AS n, count(score)::BIGINT AS scored FROM predictions GROUP BY ALL")
def label_strip(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "predictions").select("model", F.replace("label", F.lit("__label__"), F.lit("")).alias("label"), "score")
    return p.groupBy("model", "label").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query("SELECT doc_id, '__label__' || source || ' ' || replace(text, chr(10), ' ') AS value FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).where("text IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", T.label_line("source", models.one_line("text")).alias("value"))


@query("SELECT page_id FROM (SELECT DISTINCT page_id, html_bytes FROM pages WHERE warc_type = 'response' AND octet_length(html_bytes) <= 100000000)")
def response_records(spark: SparkSession, sf: str) -> DataFrame:
    return filters.records(table(spark, sf, "pages"), "response", "html_bytes").select("page_id", "html_bytes").distinct().select("page_id")


@query()
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = filters.records(table(spark, sf, "pages"), "response", "html_bytes").dropDuplicates(["page_id"])
    return p.select("page_id", html.extract_text("html_bytes").alias("text"))


@query()
def utf8_repair(spark: SparkSession, sf: str) -> DataFrame:
    p = filters.records(table(spark, sf, "pages"), "response", "html_bytes").dropDuplicates(["page_id"])
    return p.select("page_id", filters.decode_utf8("html_bytes").alias("text"))


# --- dedup ---


@query(
    """WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM
  (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\n]*\\n|[^\\n]+') AS ls FROM documents WHERE text IS NOT NULL)),
 c AS (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM l),
 k AS (SELECT doc_id, string_agg(line, '' ORDER BY pos) AS t FROM c WHERE n = 1 GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
)
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.line_dedup(docs(spark, sf))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_doc_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup(docs(spark, sf).select("doc_id", "source", "text")).select("doc_id", "source")


@query(f"SELECT lo, hi, round(jaccard, 9) AS jaccard FROM {_PAIRS}")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs between the first documents of equal shingle sets."""
    return dedup.similarity_pairs(docs(spark, sf)).select("lo", "hi", F.round("jaccard", 9).alias("jaccard"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(s, []::VARCHAR[])) AS rep FROM {_SETS}")
def duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the first document of the same shingle set."""
    return dedup.set_classes(docs(spark, sf)).select(F.col("id").alias("doc_id"), "rep")


@query(f"SELECT id, seed, value FROM {_MIN}")
def minhash_signature(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.minhash(docs(spark, sf), 8)


@query(f"""WITH b AS (SELECT id, (seed // 4)::INTEGER AS band, md5(string_agg(value, ',' ORDER BY seed)) AS bucket FROM {_MIN} GROUP BY 1, 2), w AS (SELECT id, string_agg(bucket, ',' ORDER BY band) AS sig FROM b GROUP BY id), k AS (SELECT min(id) AS id FROM w GROUP BY sig), x AS (SELECT b.* FROM b JOIN k USING (id))
 SELECT DISTINCT a.id AS lo, c.id AS hi FROM x a JOIN x c ON a.band = c.band AND a.bucket = c.bucket AND a.id < c.id""")
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.lsh_candidates(durable(dedup.minhash(docs(spark, sf), 8)), 8, 2)


@query(_COMP + "SELECT doc_id, component FROM c")
def fuzzy_components(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fuzzy_components(docs(spark, sf))


@query(_COMP + "SELECT c.doc_id, d.source FROM c JOIN documents d ON c.doc_id = d.doc_id WHERE c.doc_id = component")
def fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fuzzy_dedup(docs(spark, sf).select("doc_id", "source", "text")).select("doc_id", "source")


@query()
def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.greedy_dedup(docs(spark, sf).where("text IS NOT NULL").select("doc_id", "source", "text")).select("doc_id", "source")


@query()
def two_level_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.two_level_dedup(docs(spark, sf).where("text IS NOT NULL").select("doc_id", "shard", "text"), "shard").select("doc_id", "shard")


# --- budgets, splits, interleaving ---


def sized(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text IS NOT NULL AND text <> ''").select("doc_id", "source", "lang", F.length("text").cast("long").alias("n"))


_SIZED = "(SELECT doc_id, source, lang, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND text <> '')"


@query(f"SELECT doc_id, total_before FROM (SELECT doc_id, {_ORDER_TOTAL.format(v='n', o='doc_id')}::BIGINT AS total_before FROM {_SIZED}) WHERE total_before < 500000")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.token_budget(sized(spark, sf), ["doc_id"], "n", 500_000).select("doc_id", "total_before")


@query(
    f"""SELECT doc_id, lang, total_before FROM (SELECT doc_id, lang, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before
 FROM {_SIZED} WHERE lang IN ('en', 'fr', 'de', 'es', 'pt')) WHERE total_before < 400000 // 5"""
)
def per_lang_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = sized(spark, sf).where(F.col("lang").isin("en", "fr", "de", "es", "pt"))
    return sampling.group_budget(d, "lang", ["doc_id"], "n", 400_000, 5).select("doc_id", "lang", "total_before")


@query(f"SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS turn FROM {_SIZED}")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.round_robin(sized(spark, sf), "source", ["doc_id"]).select("doc_id", "source", "turn")


@query("SELECT source, shard FROM (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard) AS rn FROM (SELECT DISTINCT source, shard FROM shards WHERE source IS NOT NULL AND shard IS NOT NULL)) WHERE rn <= 3")
def top_files_per_type(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "shards").where("source IS NOT NULL AND shard IS NOT NULL").select("source", "shard").distinct()
    return sampling.top_per_group(s, "source", ["shard"], 3).select("source", "shard")


@query(
    """SELECT doc_id, CASE WHEN r <= n * 90 // 100 THEN 'train' ELSE 'valid' END AS split FROM
 (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)"""
)
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.exact_split(docs(spark, sf).select("doc_id"), "doc_id").select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_k(docs(spark, sf).select("doc_id"), "doc_id", 100)


@query(
    """WITH f AS (SELECT shard, row_number() OVER (ORDER BY shard) AS k FROM (SELECT DISTINCT shard FROM documents)),
 d AS (SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS rn FROM documents)
 SELECT d.doc_id, d.shard FROM d JOIN f ON d.shard = f.shard WHERE rn <= 3 + CASE WHEN k <= 7 THEN 1 ELSE 0 END"""
)
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows of each shard, one more of the first seven."""
    d = docs(spark, sf).select("doc_id", "shard")
    n = d.select("shard").distinct().count()
    return sampling.file_quota(d, "shard", ["doc_id"], 3 * n + 7, n).select("doc_id", "shard")


@query(f"SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM {_SIZED}")
def batch_number(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batch_number(sized(spark, sf), ["doc_id"], 100).select("doc_id", "batch_id")


@query(
    f"""WITH RECURSIVE o AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) AS r FROM {_SIZED}),
 s AS (SELECT doc_id, r, n AS filled, 0::BIGINT AS shard FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN s.filled >= 100000 THEN o.n ELSE s.filled + o.n END, CASE WHEN s.filled >= 100000 THEN s.shard + 1 ELSE s.shard END FROM s JOIN o ON o.r = s.r + 1)
 SELECT doc_id, shard FROM s"""
)
def greedy_shards(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.greedy_shards(sized(spark, sf), ["doc_id"], "n", 100_000).select("doc_id", F.col("shard").cast("long").alias("shard"))


# --- tokens ---

_TOK = f"(SELECT doc_id, list_transform({_words('text')}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50257) AS tokens FROM documents WHERE text IS NOT NULL AND text <> '')"


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text IS NOT NULL AND text <> ''").select("doc_id", tokens.word_ids().alias("tokens"))


@query(f"SELECT doc_id, array_to_string(tokens, ' ') AS ids, (2 * len(tokens))::BIGINT AS n_bytes FROM {_TOK}")
def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenized(spark, sf).select("doc_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("ids"), tokens.token_bytes().alias("n_bytes"))


@query(f"SELECT doc_id, {_ORDER_TOTAL.format(v='len(tokens)', o='doc_id')}::BIGINT AS \"offset\" FROM {_TOK}")
def token_stream(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.stream_positions(tokenized(spark, sf), ["doc_id"]).select("doc_id", "offset")


@query(
    f"""SELECT doc_id, start::INTEGER AS start, array_to_string(list_slice(tokens, start + 1, start + 64), ' ') AS x, array_to_string(list_slice(tokens, start + 2, start + 65), ' ') AS y
 FROM (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 64, 64)) AS start FROM {_TOK} WHERE len(tokens) > 64)"""
)
def eval_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = tokens.eval_windows(tokenized(spark, sf), 64)
    s = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return w.select("doc_id", "start", s("x"), s("y"))


@query("SELECT doc_id, ((r - 1) // 16)::BIGINT AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) // 16 < 20")
def eval_batches(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.batches(docs(spark, sf).select("doc_id"), ["doc_id"], 16, 20).select("doc_id", "batch")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 4 = 1")
def rank_stripe(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.rank_stripe(docs(spark, sf).select("doc_id"), ["doc_id"], 1, 4).select("doc_id")


@query(f"SELECT doc_id, (CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % (len(tokens) - 64))::INTEGER AS start FROM {_TOK} WHERE len(tokens) > 64")
def random_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.random_windows(tokenized(spark, sf), 64, 7).select("doc_id", "start")


# --- runs, planning ---

_STEPS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY logged_at NULLS LAST, train_loss NULLS LAST, eval_loss NULLS LAST, smoothed_loss NULLS LAST, lr NULLS LAST) AS r FROM run_history) WHERE r = 1)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return runs.distinct_steps(table(spark, sf, "run_history"))


@query(f"SELECT run_id, step, round(avg(train_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS trailing FROM {_STEPS}")
def rolling_loss(spark: SparkSession, sf: str) -> DataFrame:
    return runs.trailing_mean(steps(spark, sf)).select("run_id", "step", F.round("trailing", 6).alias("trailing"))


@query(
    f"""SELECT run_id, count(*)::BIGINT AS steps, min(train_loss) AS min_train_loss, max_by(train_loss, step) FILTER (step IS NOT NULL) AS final_train_loss, min(smoothed_loss) AS min_smoothed_loss, min(eval_loss) AS min_eval_loss,
 max_by(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS final_eval_loss, arg_min_null(lr, step) AS initial_lr, arg_max_null(lr, step) AS final_lr FROM {_STEPS} GROUP BY run_id"""
)
def loss_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.summary(steps(spark, sf)).select("run_id", "steps", "min_train_loss", "final_train_loss", "min_smoothed_loss", "min_eval_loss", "final_eval_loss", "initial_lr", "final_lr")


@query(f"SELECT t.run_id, t.step, t.train_loss, e.eval_loss FROM {_STEPS} t LEFT JOIN (SELECT run_id, step, eval_loss FROM {_STEPS} WHERE eval_loss IS NOT NULL) e ON t.run_id = e.run_id AND t.step = e.step WHERE t.train_loss IS NOT NULL")
def left_join_eval(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf)
    return runs.left_join_eval(s.where("train_loss IS NOT NULL").select("run_id", "step", "train_loss"), s.where("eval_loss IS NOT NULL").select("run_id", "step", "eval_loss"))


@query(f"SELECT step, round(avg(train_loss), 6) AS mean_loss, count(train_loss)::BIGINT AS n_runs FROM {_STEPS} GROUP BY step")
def mean_loss_by_step(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).groupBy("step").agg(F.round(F.avg("train_loss"), 6).alias("mean_loss"), F.count("train_loss").alias("n_runs"))


_LOG = [
    "Training step 0, Loss: 10.8251, Smoothed Loss: 10.8251, lr: 0.000001] trailing",
    "Training step 50, Loss: 7.5, Smoothed Loss: 8.25, lr: 3e-4",
    "Training step 51, Loss: oops, Smoothed Loss: 8.25, lr: 3e-4",
    "Training step 52, Loss: 7.4",
    "eval_loss 3.5",
    "Training step x, Loss: 7.5, Smoothed Loss: 8.25, lr: 3e-4",
]


@query(
    "WITH l(line) AS (VALUES " + ", ".join(f"('{x}')" for x in _LOG) + """), p AS (SELECT string_split(string_split(trim(line), ']')[1], ', ') AS f FROM l WHERE starts_with(line, 'Training step')),
 v AS (SELECT TRY_CAST(string_split(f[1], ' ')[-1] AS BIGINT) AS step, TRY_CAST(string_split(f[2], ': ')[-1] AS DOUBLE) AS train_loss, TRY_CAST(string_split(f[3], ': ')[-1] AS DOUBLE) AS smoothed_loss, TRY_CAST(string_split(f[4], ': ')[2] AS DOUBLE) AS lr FROM p)
 SELECT * FROM v WHERE step IS NOT NULL AND train_loss IS NOT NULL AND smoothed_loss IS NOT NULL AND lr IS NOT NULL"""
)
def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Inline log lines; no table holds raw logs."""
    return runs.parse_log(spark.createDataFrame([(x,) for x in _LOG], "line string"))


@query(f"SELECT run_id, step, round(CASE WHEN step < 500 THEN 6e-4 * step / 500 WHEN step > 5000 THEN 6e-5 ELSE 6e-5 + (cos(3.141592653589793 * ((step - 500) / 4500.0)) + 1.0) * 0.5 * (6e-4 - 6e-5) END, 9) AS rate FROM {_STEPS}")
def cosine_lr(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("run_id", "step", F.round(planning.cosine_rate(F.col("step"), 6e-4, 6e-5, 500, 5000), 9).alias("rate"))


@query(f"SELECT run_id, step, round(CASE WHEN step < 500 THEN 6e-4 * step / 500 WHEN step < 3500 THEN 6e-4 WHEN step < 5000 THEN 6e-5 + (6e-4 - 6e-5) * (1 - (step - 3500) / 1500.0) ELSE 6e-5 END, 9) AS rate FROM {_STEPS}")
def wsd_lr(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("run_id", "step", F.round(planning.stable_decay_rate(F.col("step"), 6e-4, 6e-5, 500, 3000, 1500), 9).alias("rate"))


_PLAN = """(WITH g AS (SELECT b::DOUBLE AS flops_budget, r::DOUBLE AS ratio FROM (VALUES (1e17), (3e17), (1e18), (3e18), (1e19)) x(b), (VALUES (5), (10), (20), (40), (60)) y(r) WHERE b < 1e19 OR r = 20),
 n AS (SELECT *, floor(sqrt(flops_budget / (6.0::DOUBLE * ratio)))::BIGINT AS model_size_params FROM g),
 d AS (SELECT *, floor(flops_budget / (6.0::DOUBLE * model_size_params))::BIGINT AS training_tokens, CASE WHEN model_size_params <= 120000000 THEN 262144 ELSE 524288 END::BIGINT AS batch_size FROM n)
 SELECT *, training_tokens // model_size_params AS tokens_per_param, training_tokens // batch_size AS iterations,
  round_even(6.0::DOUBLE * model_size_params::DOUBLE * training_tokens::DOUBLE / (989e12::DOUBLE * 0.2::DOUBLE) / 3600.0::DOUBLE, 1) AS train_hours FROM d)"""


@query(f"SELECT flops_budget, ratio, model_size_params, training_tokens, tokens_per_param, batch_size, iterations, train_hours FROM {_PLAN}")
def isoflop_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planning.isoflop_plan(spark).select("flops_budget", "ratio", "model_size_params", "training_tokens", "tokens_per_param", "batch_size", "iterations", "train_hours")


@query(f"SELECT flops_budget, count(*)::BIGINT AS experiments, round(sum(training_tokens)::DOUBLE / 1e6::DOUBLE, 6) AS tokens_m, round(max(model_size_params)::DOUBLE / 1e6::DOUBLE, 6) AS largest_m, round(sum(train_hours), 3) AS hours FROM {_PLAN} GROUP BY flops_budget")
def plan_report(spark: SparkSession, sf: str) -> DataFrame:
    r = planning.plan_report(planning.isoflop_plan(spark))
    return r.select("flops_budget", "experiments", F.round("tokens_m", 6).alias("tokens_m"), F.round("largest_m", 6).alias("largest_m"), F.round("hours", 3).alias("hours"))


@query(
    """SELECT DISTINCT experiment_id, d_model, d_ff, num_layers, ((4 * d_model::BIGINT * d_model + 3 * d_model::BIGINT * d_ff) * num_layers)::BIGINT AS params, train_steps::BIGINT * 262144 * (batch_size // 262144) AS tokens,
 768.0 / d_model AS attn_lr_scale, 2048.0 / d_ff AS ffn_lr_scale FROM scaling_runs"""
)
def param_count(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scaling_runs")
    d = planning.width_scales(s, 768.0, 2048.0)
    return d.select(
        "experiment_id", "d_model", "d_ff", "num_layers",
        planning.model_size(F.col("d_model"), F.col("d_ff"), F.col("num_layers")).alias("params"),
        planning.run_tokens(F.col("train_steps"), F.expr("batch_size div 262144")).alias("tokens"),
        "attn_lr_scale", "ffn_lr_scale",
    ).distinct()


@query("SELECT experiment_id, count(*)::BIGINT AS n, min(valid_loss) AS best, max(valid_loss) AS worst, min_by(model_size_params, valid_loss) AS best_params, sum(training_tokens)::BIGINT AS tokens FROM (SELECT DISTINCT * FROM scaling_runs) GROUP BY experiment_id")
def scaling_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scaling_runs").distinct()
    return s.groupBy("experiment_id").agg(
        F.count("*").alias("n"), F.min("valid_loss").alias("best"), F.max("valid_loss").alias("worst"),
        F.min_by("model_size_params", "valid_loss").alias("best_params"), F.sum("training_tokens").alias("tokens"),
    )


@query("SELECT embeddings_scale, init_std, lr, valid_loss FROM (SELECT DISTINCT embeddings_scale, init_std, lr, valid_loss FROM search_trials WHERE valid_loss IS NOT NULL) ORDER BY valid_loss, lr LIMIT 5")
def best_trials(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "search_trials").where("valid_loss IS NOT NULL").select("embeddings_scale", "init_std", "lr", "valid_loss").distinct()
    return t.orderBy("valid_loss", "lr").limit(5)


@query(
    "WITH o(id, out) AS (VALUES (1, 'Training step 1, Loss: 5.5' || chr(13) || 'Training step 2, Loss: 4.25'), (2, 'nothing'), (3, 'Final estimated validation loss: 3.25')) "
    "SELECT id, TRY_CAST(regexp_extract_all(out, 'Training step [0-9]+, Loss: ([0-9\\.eE+-]+)', 1)[-1] AS DOUBLE) AS train_loss, TRY_CAST(regexp_extract_all(out, 'Final estimated validation loss: ([0-9\\.eE+-]+)', 1)[-1] AS DOUBLE) AS valid_loss FROM o"
)
def last_loss_match(spark: SparkSession, sf: str) -> DataFrame:
    """Inline captured outputs; no table holds them."""
    o = spark.createDataFrame([(1, "Training step 1, Loss: 5.5\rTraining step 2, Loss: 4.25"), (2, "nothing"), (3, "Final estimated validation loss: 3.25")], "id int, out string")
    return o.select("id", runs.last_match("out", runs.TRAIN_LOSS).alias("train_loss"), runs.last_match("out", runs.VALID_LOSS).alias("valid_loss"))


# --- classifiers ---

_WEIGHTS = [("the", 0.4), ("of", 0.3), ("cheap", -1.5), ("buy", -1.2), ("online", -0.8), ("because", 0.9), ("click", -1.1), ("which", 0.5)]


@query(
    "WITH w(token, w) AS (VALUES " + ", ".join(f"('{t}', {v})" for t, v in _WEIGHTS)
    + f"), t AS (SELECT doc_id, unnest({_words('lower(text)')}) AS token FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, sum(w::DOUBLE) AS s FROM t JOIN w USING (token) GROUP BY doc_id) "
    "SELECT d.doc_id, round(1.0::DOUBLE / (1.0 + exp(-(coalesce(s.s, 0.0) + 0.1::DOUBLE))), 6) AS score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"
)
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    # A fixed list of weights.
    w = F.broadcast(spark.createDataFrame(_WEIGHTS, "token string, w double"))
    return models.linear_score(docs(spark, sf), w, 0.1).select("doc_id", F.round("score", 6).alias("score"))


def rated(spark: SparkSession, sf: str, column: str) -> DataFrame:
    r = table(spark, sf, "labels").where(f"{column} IS NOT NULL").groupBy("doc_id").agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a = b")
    return docs(spark, sf).where("length(text) > 0").join(r.select("doc_id", F.col("a").alias("label")), "doc_id").select("doc_id", "text", F.col("label").cast("string").alias("label"))


def _classify(spark: SparkSession, sf: str, column: str) -> DataFrame:
    m = models.train_text_classifier(rated(spark, sf, column))
    return models.predict(m, docs(spark, sf).where("length(text) > 0").select("doc_id", "text")).select("doc_id", "pred.label", "pred.score")


@query()
def classify_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf, "quality")


@query()
def classify_toxic(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf, "toxic")


def language_model(spark: SparkSession, sf: str) -> PipelineModel:
    d = docs(spark, sf).where("length(text) > 0").select("doc_id", "text", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"))
    return models.train_language_id(d.where(F.col("lang").isin("en", "fr", "de", "es", "pt", "ru", "zh")))


@query()
def identify_language(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).where("length(text) > 0").select("doc_id", "text")
    return models.predict(language_model(spark, sf), d).select("doc_id", "pred.label", "pred.score")


@query()
def classifier_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on nine tenths of the quality ratings, measure on the rest."""
    d = durable(sampling.exact_split(rated(spark, sf, "quality"), "doc_id"))
    m = models.train_text_classifier(d.where("split = 'train'"))
    p = models.predict(m, d.where("split = 'valid'"))
    return models.evaluate(p.withColumn("guess", F.col("pred.label")), "label", "guess")


# --- whole pipelines ---


@query()
def crawl_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    def fitted(column: str) -> PipelineModel:
        # Fitted on texts as the pipeline judges them: flat and masked.
        rows = nsfw_rated(spark, sf) if column == "nsfw" else rated(spark, sf, column)
        return models.train_text_classifier(durable(T.once(rows, text=T.mask_all(T.flatten("text")))))

    judges = [(fitted("nsfw"), "non-nsfw"), (fitted("toxic"), "0"), (fitted("quality"), "1")]
    d = docs(spark, sf).select("doc_id", "lang", "shard", "text")
    return pipeline.crawl_pipeline(d, "shard", language_model(spark, sf), judges).select("doc_id", "shard", "text")


@query(
    _gopher(f"SELECT doc_id, shard AS lang, {_masked(_FLAT)} AS text FROM documents WHERE lang IN ('en', 'zh') AND length({_FLAT}) >= 100")
    + """, k AS (SELECT doc_id, lang AS shard, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM g WHERE reason IS NULL), f AS (SELECT shard, row_number() OVER (ORDER BY shard) AS n FROM (SELECT DISTINCT shard FROM k))
 SELECT doc_id, '__label__neg ' || text AS value FROM k JOIN f USING (shard) WHERE rn <= 2 + CASE WHEN n <= 10 THEN 1 ELSE 0 END"""
)
def classifier_samples(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", "shard", "text")
    return pipeline.classifier_samples(d, "neg", "shard", 2 * 1000 + 10, 1000)


@query(
    f"SELECT shard, stage, count(*)::BIGINT AS docs FROM (SELECT shard, 'read' AS stage FROM documents UNION ALL SELECT shard, 'long' FROM documents WHERE length({_FLAT}) >= 100 UNION ALL SELECT shard, 'language' FROM documents WHERE length({_FLAT}) >= 100 AND lang IN ('en', 'zh')) GROUP BY shard, stage"
)
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("shard", "lang", "text")
    long = d.where(filters.long_enough(T.flatten("text")))
    return pipeline.stage_counts({"read": d, "long": long, "language": long.where(F.col("lang").isin(*filters.LANGUAGES))}, "shard").select("shard", "stage", "docs")


@query("SELECT doc_id, text || '<|endoftext|>' || chr(10) AS value FROM documents WHERE text IS NOT NULL AND text <> ''")
def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text IS NOT NULL AND text <> ''").select("doc_id", T.with_end_marker("text").alias("value"))


@query(
    "SELECT run_id, step, train_loss, NULL::DOUBLE AS eval_loss FROM run_history WHERE train_loss IS NOT NULL UNION ALL SELECT run_id, step, NULL, eval_loss FROM run_history WHERE eval_loss IS NOT NULL"
)
def union_history(spark: SparkSession, sf: str) -> DataFrame:
    """Train and evaluation rows together, missing columns null."""
    h = table(spark, sf, "run_history")
    t = h.where("train_loss IS NOT NULL").select("run_id", "step", "train_loss")
    return t.unionByName(h.where("eval_loss IS NOT NULL").select("run_id", "step", "eval_loss"), allowMissingColumns=True)


# --- selections and names of the acquisition steps ---


@query("SELECT doc_id, url FROM documents WHERE NOT contains(url, 'c4') AND NOT contains(url, 'cc')")
def usable_urls(spark: SparkSession, sf: str) -> DataFrame:
    return files.usable_urls(docs(spark, sf).select("doc_id", "url"))


@query("SELECT string_split(url, '/')[-2] AS type, count(*)::BIGINT AS n, min(url) AS first FROM pages WHERE url IS NOT NULL GROUP BY 1")
def files_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return files.files_by_type(table(spark, sf, "pages").where("url IS NOT NULL"))


@query("SELECT shard, regexp_replace(regexp_extract(shard || '.warc.gz', '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') || '_batch_' || lpad((count(*) // 10)::VARCHAR, 3, '0') || '.txt' AS file FROM documents GROUP BY shard")
def batch_file_names(spark: SparkSession, sf: str) -> DataFrame:
    n = docs(spark, sf).groupBy("shard").agg(F.count("*").alias("n"))
    return n.select("shard", files.batch_name(files.file_stem(F.concat("shard", F.lit(".warc.gz"))), F.expr("n div 10")).alias("file"))


@query("SELECT shard, source FROM (SELECT DISTINCT shard, source, listed_at FROM shards WHERE listed_at IS NOT NULL) ORDER BY listed_at DESC, shard LIMIT 1")
def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "shards").where("listed_at IS NOT NULL").select("shard", "source", "listed_at").distinct()
    return s.orderBy(F.col("listed_at").desc(), "shard").limit(1).select("shard", "source")


@query("SELECT shard FROM (SELECT DISTINCT shard FROM shards WHERE shard IS NOT NULL) ORDER BY shard LIMIT 50")
def first_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.first_files(table(spark, sf, "shards").where("shard IS NOT NULL").select("shard").distinct(), 50, "shard")


@query(
    f"""SELECT doc_id, source, turn, total_before FROM (SELECT *, {_ORDER_TOTAL.format(v='n', o='turn, source')}::BIGINT AS total_before FROM
 (SELECT doc_id, source, n, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS turn FROM {_SIZED})) WHERE total_before < 300000"""
)
def interleaved_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.interleaved_budget(sized(spark, sf), "source", ["doc_id"], "n", 300_000).select("doc_id", "source", "turn", "total_before")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def drop_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.drop_ids(docs(spark, sf).select("doc_id", "source"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query(
    f"""SELECT doc_id, start, round(sum(-ln(((CAST('0x' || substr(md5('3:' || doc_id || ':' || start), 1, 8) AS BIGINT))::DOUBLE + 0.5) / 4294967296.0)) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING), 6) AS arrival
 FROM (SELECT doc_id, unnest(range(0, len(tokens) - 64, 64))::INTEGER AS start FROM {_TOK} WHERE len(tokens) > 64)"""
)
def train_draws(spark: SparkSession, sf: str) -> DataFrame:
    w = tokens.eval_windows(tokenized(spark, sf), 64).select("doc_id", "start")
    return tokens.train_draws(w, 3).select("doc_id", "start", F.round("arrival", 6).alias("arrival"))


@query("SELECT sum(numel)::BIGINT AS total, sum(CASE WHEN NOT contains(lower(name), 'embedding') THEN numel ELSE 0 END)::BIGINT AS without_embeddings FROM (VALUES ('token_embeddings.weight', 25728640), ('layers.0.attn.weight', 1048576), ('layers.0.ffn.w1.weight', 1441792), ('lm_head.weight', 25728640)) t(name, numel)")
def nonembedding_params(spark: SparkSession, sf: str) -> DataFrame:
    """An inline table of names and element counts; no table holds one."""
    rows = [("token_embeddings.weight", 25728640), ("layers.0.attn.weight", 1048576), ("layers.0.ffn.w1.weight", 1441792), ("lm_head.weight", 25728640)]
    return planning.parameter_count(spark.createDataFrame(rows, "name string, numel long"))


@query("SELECT run_id, step, (step::BIGINT * 262144) // 524288 AS warmup FROM run_history WHERE step IS NOT NULL")
def warmup_steps(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "run_history").where("step IS NOT NULL")
    return h.select("run_id", "step", planning.warmup_steps(F.col("step").cast("long") * 262144, F.lit(524288)).alias("warmup"))


_DRAW = "(CAST('0x' || substr(md5('{seed}:' || id), 1, 8) AS BIGINT)::DOUBLE / 4294967296::DOUBLE)"


def _three(x: str) -> str:
    return f"(round({x} / pow(10::DOUBLE, floor(log10({x}))), 2) * pow(10::DOUBLE, floor(log10({x}))))"


@query(
    "WITH u AS (SELECT range AS id FROM range(30)), d AS (SELECT id, "
    + f"{_DRAW.format(seed=42)} * 19 + 1 AS a, exp(ln(1e-4::DOUBLE) + {_DRAW.format(seed=43)} * (ln(0.2::DOUBLE) - ln(1e-4::DOUBLE))) AS b, exp(ln(1e-4::DOUBLE) + {_DRAW.format(seed=44)} * (ln(0.1::DOUBLE) - ln(1e-4::DOUBLE))) AS c FROM u)"
    + f" SELECT id::BIGINT AS trial, round({_three('a')}, 9) AS embeddings_scale, round({_three('b')}, 9) AS init_std, round({_three('c')}, 9) AS lr FROM d"
)
def search_params(spark: SparkSession, sf: str) -> DataFrame:
    return planning.search_params(spark, 30, 42).select("trial", *(F.round(c, 9).alias(c) for c in ("embeddings_scale", "init_std", "lr")))


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) * 16 / (count(*) OVER ())::DOUBLE)::INTEGER AS chunk FROM documents")
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.line_chunks(docs(spark, sf).select("doc_id"), ["doc_id"]).select("doc_id", "chunk")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 21")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A limit that is the feature: the demonstration run's first rows."""
    return sampling.first_rows(docs(spark, sf).select("doc_id", "source"), ["doc_id"])


def nsfw_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts on which every entry of the older scorer's log agrees; no human rating exists, so this
    teaches that scorer's judgement and no more."""
    p = table(spark, sf, "predictions").where("model = 'nsfw' AND label IS NOT NULL").select("doc_id", F.replace("label", F.lit("__label__"), F.lit("")).alias("label"))
    r = p.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("b")).where("label = b").select("doc_id", "label")
    return docs(spark, sf).where("length(text) > 0").select("doc_id", "text").join(r, "doc_id")


@query()
def classify_nsfw(spark: SparkSession, sf: str) -> DataFrame:
    m = models.train_text_classifier(nsfw_rated(spark, sf))
    return models.predict(m, docs(spark, sf).where("length(text) > 0").select("doc_id", "text")).select("doc_id", "pred.label", "pred.score")
