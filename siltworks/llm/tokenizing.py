"""Token counts of public tokenizers, read from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from siltworks.llm.batches import map_columns

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published pre-tokenisation pattern of byte-level BPE vocabularies; fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    e = encoding(path)
    return [len(e.encode_ordinary(t)) if t and t.strip() else 0 for t in texts]


def token_counts(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_tokens`` (and ``keep``) per row; null or blank text counts 0."""
    types = dict(docs.dtypes)
    ddl = f"{id_col} {types[id_col]}, n_tokens long" + "".join(f", {k} {types[k]}" for k in keep)
    return map_columns(
        docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), *keep),
        ["_i", "_t", *keep],
        ddl,
        lambda ids, texts, *rest: [ids, count_tokens(texts, path), *rest],
    )
