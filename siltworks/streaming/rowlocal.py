"""Row-local filters on streams: an extension.  These are the batch expressions,
which hold no state and so apply to a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.functions import text as T
from siltworks.operators import filters


def clean_stream(docs: DataFrame) -> DataFrame:
    """Flattened, long enough, masked and passing the quality rules; batch or streaming."""
    d = T.once(docs, text=T.flatten("text")).where(filters.long_enough(F.col("text")))
    return filters.quality_stats(T.once(d, text=T.mask_all("text"))).where("passes")
