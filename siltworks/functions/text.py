"""Text expressions built from JVM functions only.

White space is Python's: the 29 code points of ``str.split``.  The same spelling of the class works
in Java's regular expressions and in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space of Python's str.split; fixed value.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EOT = "<|endoftext|>"
# Mask patterns and placeholders of the crawl pipeline; fixed values.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
EMAIL_MASK, PHONE_MASK, IP_MASK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def universal_newlines(x: Column | str) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``, as reading in text mode does."""
    return F.regexp_replace(_c(x), r"\r\n?", "\n")


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def flatten(x: Column | str) -> Column:
    """Newlines to spaces, then strip."""
    return strip(F.replace(_c(x), F.lit("\n"), F.lit(" ")))


def words(x: Column | str) -> Column:
    """Words between runs of white space; no empty words."""
    return F.filter(F.split(_c(x), f"{WS}+"), lambda w: w != "")


def mask(x: Column | str, pattern: str, placeholder: str) -> tuple[Column, Column]:
    """The masked text and the number of matches."""
    return F.regexp_replace(_c(x), pattern, placeholder), F.regexp_count(_c(x), F.lit(pattern))


def mask_all(x: Column | str) -> Column:
    """Emails, then phone numbers, then addresses of four dotted numbers."""
    t = F.regexp_replace(_c(x), EMAIL, EMAIL_MASK)
    t = F.regexp_replace(t, PHONE, PHONE_MASK)
    return F.regexp_replace(t, IPV4, IP_MASK)


def ngrams(ws: Column, n: int) -> Column:
    """All ``n``-word sequences in order; none if there are fewer than ``n`` words."""

    def grams(w: Column) -> Column:
        size = F.size(w)
        return F.when(
            size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        ).otherwise(F.array().cast("array<string>"))

    # Bound to a lambda variable, the word list is computed once and not again for every sequence.
    return F.element_at(F.transform(F.array(ws), grams), 1)


def ngram_set(ws: Column, n: int) -> Column:
    return F.array_distinct(ngrams(ws, n))


def terminated_lines(x: Column | str) -> Column:
    """Lines with their terminators; a last line may lack one."""
    return F.regexp_extract_all(_c(x), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def with_end_marker(x: Column | str) -> Column:
    return F.concat(_c(x), F.lit(EOT), F.lit("\n"))


def label_line(label: Column | str, x: Column | str) -> Column:
    """``__label__L text`` on one line."""
    return F.concat(F.lit("__label__"), _c(label), F.lit(" "), _c(x))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that are computed exactly once per row.

    A generator of one row keeps the optimizer from copying a costly expression into every place
    that uses its column, filters among them.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
