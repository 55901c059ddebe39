"""Exact and fuzzy removal of duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltworks.functions import text as T
from siltworks.functions.normalize import TokenWords, mix64, normalize_text, shingle_sets, word_hash
from siltworks.operators.partenum import not_among, pairs_of
from siltworks.session import durable

#: Rows whose shingle sets are in memory at once.
KEY_ROWS = 1024


def line_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Drops every copy of any line that occurs more than once in the collection.

    Lines keep their terminators, so an unterminated last line differs from its terminated twin.
    Documents that lose all lines stay, with empty text; null texts stay null.
    """
    src = df.select(F.col(id_col), T.universal_newlines(text).alias("_t"))
    lines = src.select(id_col, F.posexplode(T.terminated_lines("_t")).alias("pos", "line"))
    once = lines.groupBy("line").agg(F.count("*").alias("c")).where("c = 1").select("line")
    kept = lines.join(once, "line", "left_semi").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return src.join(kept, id_col, "left").select(
        id_col, F.when(F.col("_t").isNotNull(), F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), ""), F.lit(""))).alias(text)
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each text, by id.  The minimum is combined before the shuffle, so a
    text held by a third of all rows is no burden."""
    first = df.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(first, id_col, "left_semi")


def shingles(df: DataFrame, n: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, grams``: the set of word ``n``-grams of the normalised text."""
    norm = df.select(F.col(id_col).alias("id"), normalize_text(text).alias("_n"))
    return T.once(norm, grams=T.ngram_set(F.filter(F.split("_n", " "), lambda w: w != ""), n)).select("id", "grams")


def set_keys(df: DataFrame, n: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, h``: a 128-bit hash of the shingle set; the sets stay where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = TokenWords(), pa.schema([("id", pa.int64()), ("h", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, KEY_ROWS):
                x = b.slice(at, KEY_ROWS)
                flat, sizes = shingle_sets(x.column(1).to_pylist(), known, n)
                h = [blake2b(flat[e - k : e], digest_size=16).digest() for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(h, pa.binary())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, h binary")


def set_classes(df: DataFrame, n: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, rep``: each document and the first document with the same shingle set."""
    keys = durable(set_keys(df, n, id_col, text))
    rep = keys.groupBy("h").agg(F.min("id").alias("rep"))
    return durable(keys.join(rep, "h").select("id", "rep"))


def similarity_pairs(df: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``lo, hi, jaccard`` between all distinct shingle sets at least ``threshold`` similar.

    Documents with equal sets are represented by the first id; membership comes from
    :func:`set_classes`.  Sets without shingles are all alike and form one class.
    """
    return pairs_of_classes(df, set_classes(df, n, id_col, text), n, threshold, id_col, text)


def pairs_of_classes(df: DataFrame, classes: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of the representatives in ``classes``, by PartEnum signatures, which travel instead of sets."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    first = not_among(texts, classes.where("id <> rep").select("id"))
    return pairs_of(texts, first, threshold, n).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "jaccard")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the least id of each connected component.

    Large-star and small-star contraction: rounds grow with the logarithm of the path length, and no
    vertex gathers its neighbours in one task.
    """
    e = durable(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: greater neighbours hang on the least.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours, and the vertex, hang on the least of them.
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen:
            break
        seen = state
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.select("id").join(root.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def fuzzy_components(df: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, component`` per document."""
    classes = set_classes(df, n, id_col, text)
    edges = durable(pairs_of_classes(df, classes, n, threshold, id_col, text), free=True)
    reps = classes.where("id = rep").select("id")
    comp = components(reps, edges)
    return classes.select(F.col("id").alias(id_col), "rep").join(comp.withColumnRenamed("id", "rep"), "rep").select(id_col, "component")


def fuzzy_dedup(df: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The least document of each component."""
    c = fuzzy_components(df, n, threshold, id_col, text)
    return df.join(c.where(F.col(id_col) == F.col("component")).select(id_col), id_col, "left_semi")


def minhash(df: DataFrame, seeds: int, n: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, seed, value``: the least MD5 of ``seed:gram`` over each document's shingles."""
    # A document's shingles are in its own row, so the minima need no shuffle.
    least = F.transform(
        F.sequence(F.lit(0), F.lit(seeds - 1)),
        lambda k: F.struct(k.alias("seed"), F.array_min(F.transform("grams", lambda g: F.md5(F.concat(k.cast("string"), F.lit(":"), g)))).alias("value")),
    )
    return shingles(df, n, id_col, text).where(F.size("grams") > 0).select("id", F.inline(least))


def lsh_candidates(signatures: DataFrame, seeds: int, bands: int) -> DataFrame:
    """Distinct pairs that agree on a band of the signature.  Documents with one whole signature are
    represented by the first of them."""
    if seeds % bands:
        raise ValueError("the number of hashes must be a multiple of the number of bands")
    rows = seeds // bands
    buckets = (
        signatures.withColumn("band", F.floor(F.col("seed") / rows).cast("int"))
        .groupBy("id", "band")
        .agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"]), ",")).alias("bucket"))
    )
    whole = buckets.groupBy("id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "bucket"))), lambda x: x["bucket"]), ",")).alias("sig"))
    rep = whole.groupBy("sig").agg(F.min("id").alias("id")).select("id")
    b = durable(buckets.join(rep, "id", "left_semi"))
    return (
        b.alias("a").join(b.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id")))
        .select(F.col("a.id").alias("lo"), F.col("b.id").alias("hi"))
        .distinct()
    )


# --- greedy keep-first dedup on word sets -------------------------------------------------------

PERMUTATIONS, BANDS, ROWS = 128, 9, 13


def _word_sketch(text: str) -> np.ndarray | None:
    """128 least hashes of the distinct words, raw text."""
    ws = set(text.split())
    if not ws:
        return None
    h = np.array([word_hash(w) for w in ws], dtype=np.uint64)
    seeds = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(h), 512):
        out = np.minimum(out, mix64(h[a : a + 512, None] ^ seeds[None, :]).min(axis=0))
    return out


def sketch_buckets(df: DataFrame, id_col: str = "doc_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """``id, bucket``: the nine buckets of every document's word sketch, one a band of thirteen rows, apart
    for every ``scope`` if given; documents that share one are neighbours, without verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("scope", pa.string()), ("band", pa.int32()), ("bucket", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            none = np.zeros(PERMUTATIONS, np.uint64)
            m = np.stack([none if (x := _word_sketch(t or "")) is None else x for t in b.column(1).to_pylist()])
            keys = []
            for k in range(BANDS):
                key = np.full(len(m), k + 1, dtype=np.uint64)
                for v in m[:, k * ROWS : (k + 1) * ROWS].T:
                    key = mix64(key ^ v)
                keys.append(key.astype(np.int64))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0)] * BANDS),
                    pa.concat_arrays([b.column(2)] * BANDS),
                    pa.array(np.repeat(np.arange(BANDS, dtype=np.int32), n)),
                    pa.array(np.concatenate(keys)),
                ],
                schema=schema,
            )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"))
    b = src.mapInArrow(run, "id long, scope string, band int, bucket long")
    return b.select("id", F.xxhash64("bucket", F.coalesce("scope", F.lit("")), F.col("scope").isNull()).alias("bucket"))


def greedy_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """Keep-first in id order, where only kept documents suppress later neighbours.

    Exact copies go first.  Then rounds over buckets, never over pairs: a document that is the least
    undecided one of all its buckets is kept, and the other documents of its buckets are dropped, until
    all are decided.  A bucket costs its rows, however many they are.
    """
    by = [F.sha2(text, 256).alias("_h")] + ([F.col(scope).alias("_s")] if scope else [])
    first = df.groupBy(*by).agg(F.min(id_col).alias(id_col)).select(id_col)
    base = durable(df.join(first, id_col, "left_semi"))
    every = durable(sketch_buckets(base, id_col, text, scope))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = durable(every.join(shared, "bucket", "left_semi"))
    dropped = None
    while not live.isEmpty():
        least = live.groupBy("bucket").agg(F.min("id").alias("m"))
        held = live.join(least, "bucket")
        kept = held.groupBy("id").agg(F.max(F.col("m") < F.col("id")).alias("later")).where("NOT later").select("id")
        taken = durable(held.join(kept, "id", "left_semi").select("bucket").distinct())
        out = durable(live.join(taken, "bucket", "left_semi").join(kept, "id", "left_anti").select("id").distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        live = durable(live.join(taken, "bucket", "left_anti").join(out, "id", "left_anti").join(kept, "id", "left_anti"))
    if dropped is None:
        return base
    return base.join(dropped.select(F.col("id").alias(id_col)), id_col, "left_anti")


def two_level_dedup(df: DataFrame, file_col: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Greedy within each file, then over all that is left; not the same as one global pass."""
    return greedy_dedup(greedy_dedup(df, id_col, text, scope=file_col), id_col, text)
