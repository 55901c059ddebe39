"""Problem 8: laying documents into containers of fixed token capacity.

An item's cost is ``LINEAR * n + QUADRATIC * n * n`` (attention within the document).  Items go in
descending order to the sequence of lowest cost that still has room for them; a sequence is opened
when none has, and in the end sequences whose items all find room elsewhere are closed again.  Only documents over the capacity are split, into full pieces and a rest.

Items are spread over blocks of about ``BLOCK`` items by a hash of their id, and every block is
packed on its own: the work is linear in the items and the loss is at most a few sequences a block.

Defined results: null or blank texts and documents of no tokens are in no container; ties go to the
smaller id; specs without a positive capacity are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.tokenizing import DEFAULT_VOCABULARY, token_counts
from siltworks.session import durable

BLOCK = 8192
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each item; ``sizes`` descend and are at most ``capacity``."""
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    # The least number of sequences that could do: by volume, and by items that cannot share one.
    k = max(1, -(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))
    room = np.full(n + k, capacity, dtype=np.int64)
    cost = np.full(n + k, np.inf)
    cost[:k] = 0.0
    for i, s in enumerate(sizes.tolist()):
        c = np.where(room[:k] >= s, cost[:k], np.inf)
        j = int(c.argmin())
        if not np.isfinite(c[j]):
            # Nothing cheap has room: the fullest that still fits is no option either, so open one.
            j = k
            cost[k] = 0.0
            k += 1
        out[i] = j
        room[j] -= s
        cost[j] += linear * s + quadratic * s * s
    return _close(out, sizes, room[:k], capacity)


def _close(seq: np.ndarray, sizes: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the sequences with most room into others, each item where it leaves least room, as long as
    all items of a sequence find one."""
    order = np.argsort(seq, kind="stable")
    first = np.searchsorted(seq[order], np.arange(len(room) + 1))
    free = room.astype(np.int64).copy()
    for j in np.argsort(-room, kind="stable").tolist():
        mine = order[first[j] : first[j + 1]]
        if not len(mine) or free[j] != room[j]:
            continue
        trial = free.copy()
        trial[j] = -1
        # Sequences without items are closed already.
        trial[trial == capacity] = -1
        to = []
        for i in mine.tolist():
            left = np.where(trial >= sizes[i], trial - sizes[i], capacity + 1)
            k = int(left.argmin())
            if left[k] > capacity:
                break
            trial[k] -= sizes[i]
            to.append(k)
        else:
            seq[mine] = to
            free = trial
    return seq


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    seq = assign(pdf.n_tokens.to_numpy(), int(pdf.capacity_tokens.iloc[0]))
    used, dense = np.unique(seq, return_inverse=True)
    return pdf.assign(slot=dense.astype("int64"))[["pack_name", "capacity_tokens", "doc_id", "piece", "start_token", "n_tokens", "block", "slot"]]


def pack(docs: DataFrame, specs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``pack_name, capacity_tokens, doc_id, piece, start_token, n_tokens, container`` per piece."""
    counts = durable(token_counts(docs, path).where("n_tokens > 0"))
    blocks = max(1, -(-counts.count() // BLOCK))
    # One row per container size: a handful, named by the caller.
    spec = F.broadcast(specs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).where("pack_name IS NOT NULL AND capacity_tokens > 0").distinct())
    items = (
        counts.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens")
        .join(spec, F.lit(True))
        .withColumn("piece", F.explode(F.expr("sequence(0L, (n_tokens - 1) div capacity_tokens)")))
        .withColumn("start_token", F.col("piece") * F.col("capacity_tokens"))
        .withColumn("n_tokens", F.least(F.col("capacity_tokens"), F.col("n_tokens") - F.col("start_token")))
    )
    full = items.where("n_tokens = capacity_tokens").withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece"))
    rest = items.where("n_tokens < capacity_tokens").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    packed = rest.groupBy("pack_name", "block").applyInPandas(
        _pack_block, "pack_name string, capacity_tokens long, doc_id long, piece long, start_token long, n_tokens long, block long, slot long"
    )
    cols = ["pack_name", "capacity_tokens", "doc_id", "piece", "start_token", "n_tokens", "container"]
    return packed.withColumn("container", F.concat_ws("-", F.lit("b"), "block", "slot")).select(cols).unionByName(full.select(cols))


def fill_rates(packed: DataFrame) -> DataFrame:
    """Containers, pieces, tokens and fill rate per pack, and how the attention cost is spread: its mean
    and greatest value over the containers."""
    cost = F.sum(F.col("n_tokens") * LINEAR + F.col("n_tokens") * F.col("n_tokens") * QUADRATIC)
    per = packed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("p"), cost.alias("c"))
    return per.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("p").alias("pieces"),
        F.sum("n").alias("tokens"),
        (F.sum("n") / (F.count("*") * F.first("capacity_tokens"))).alias("fill_rate"),
        F.avg("c").alias("mean_cost"),
        F.max("c").alias("max_cost"),
    )
