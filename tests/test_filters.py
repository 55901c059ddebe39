from collections import Counter

import pytest

from siltworks.functions.normalize import normalize_one
from siltworks.operators import filters


def verdict(docs, t):
    r = filters.quality_stats(docs([(1, t)])).first()
    return r.passes, r.reason


@pytest.mark.parametrize(
    "text,reason",
    [
        ("word " * 49, "few_words"),
        ("word " * 50, None),
        ("word " * 100_000, None),
        ("word " * 100_001, "many_words"),
        ("abc " * 60, None),
        ("ab " * 60, "word_length"),
        ("abcdefghij " * 60, None),
        ("abcdefghijk " * 60, "word_length"),
        ("\n".join(["word " * 10 + "..."] * 3 + ["word " * 10] * 7), None),
        ("\n".join(["word " * 10 + "..."] * 4 + ["word " * 10] * 6), "ellipsis"),
        ("word " * 80 + "1234 " * 20, None),
        ("word " * 79 + "1234 " * 21, "alphabetic"),
        ("", "few_words"),
    ],
)
def test_quality_limits(docs, text, reason):
    assert verdict(docs, text.strip(" ")) == (reason is None, reason)


def test_quality_null(docs):
    assert filters.quality_stats(docs([(1, None)])).first().passes is False


def restated(text, n=3, t=0.3):
    norm = normalize_one(text)
    w = norm.split()
    g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(g.values())
    if len(norm) < 10 or not total:
        return total, len(g), max(g.values(), default=0), False
    return total, len(g), max(g.values()), len(g) / total < 1.0 - t or max(g.values()) / total > t


def test_repetition(docs):
    texts = ["a b c " * 20, "one two three four five six seven eight", "short", "", "x y", "la la la la la la la", "é É é é é é é"]
    got = {r.doc_id: (r.total, r.distinct_n, r.max_freq, r.repetitive) for r in filters.repetition_stats(docs(list(enumerate(texts)))).collect()}
    assert got == {i: restated(t) for i, t in enumerate(texts)}


def test_records_and_decoding(spark):
    d = spark.createDataFrame([("response", bytearray(b"a\xffb")), ("request", bytearray(b"c")), ("response", None)], "warc_type string, payload binary")
    rows = filters.records(d, "response").select(filters.decode_utf8("payload")).collect()
    assert [r[0] for r in rows] == ["a�b"]
