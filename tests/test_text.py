import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siltworks.functions import html, text as T
from siltworks.functions.normalize import normalize_one, normalize_text, shingle_hashes


def plain_normalize(t):
    t = unicodedata.normalize("NFD", t)
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_normalize_equals_restatement(t):
    assert normalize_one(t) == plain_normalize(t)


def test_words_follow_python_white_space(docs):
    rows = [(1, "a\x1cb c　d e\x85f"), (2, ""), (3, " \n "), (4, None), (5, "x​y")]
    got = {r.doc_id: r.w for r in docs(rows).select("doc_id", T.words("text").alias("w")).collect()}
    assert got == {i: (t.split() if t is not None else None) for i, t in rows}


def test_flatten_and_newlines(docs):
    rows = [(1, " a\r\nb\rc\n"), (2, None)]
    d = docs(rows)
    assert [r[0] for r in d.select(T.flatten("text")).collect()] == ["a\r b\rc", None]
    assert [r[0] for r in d.select(T.universal_newlines("text")).collect()] == [" a\nb\nc\n", None]


def test_masks(docs):
    rows = [
        (1, "Write to me@site.example or |||EMAIL_ADDRESS||| or you.too@b.co.uk today"),
        (2, "(415)-555-0134 and 415 555 0187 and 4155550112 and (415) 555 0199"),
        (3, "at 203.0.113.9. and 777.888.999.555"),
    ]
    d = docs(rows)
    for i, (p, m) in enumerate(((T.EMAIL, T.EMAIL_MASK), (T.PHONE, T.PHONE_MASK), (T.IPV4, T.IP_MASK))):
        masked, n = T.mask("text", p, m)
        got = d.where(f"doc_id = {i + 1}").select(masked.alias("m"), n.alias("n")).first()
        assert (got.m, got.n) == re.subn(p, lambda _: m, rows[i][1])
    assert d.where("doc_id = 3").select(T.mask_all("text")).first()[0] == f"at {T.IP_MASK}. and {T.IP_MASK}"


def test_ngrams_need_enough_words(docs):
    d = docs([(1, "a b a b a"), (2, "a b"), (3, ""), (4, None)])
    got = {r.doc_id: r.g for r in d.select("doc_id", T.ngrams(T.words("text"), 3).alias("g")).collect()}
    assert got == {1: ["a b a", "b a b", "a b a"], 2: [], 3: [], 4: []}
    assert d.where("doc_id = 1").select(T.ngram_set(T.words("text"), 3)).first()[0] == ["a b a", "b a b"]


def test_shingle_hashes_are_sets():
    assert len(shingle_hashes("a b c d e a b c d e", 5)) == 5
    assert len(shingle_hashes("a b c d", 5)) == 0


def test_normalize_column(docs):
    d = docs([(1, "Éa—Ḃ c_d"), (2, None), (3, "")])
    assert [r[0] for r in d.select(normalize_text("text")).collect()] == [plain_normalize("Éa—Ḃ c_d"), None, ""]


def test_html_layout():
    page = b"""<html><head><title>no</title><meta name=k></head><body><div><h1>The  Head</h1><div><p>
      One two
      three.</p><img src=x><p>With a <a href=y>link</a>.</p></div><div><ul>
      <li>Novel</li><li>Tale</li></ul></div><script>x()</script></body></html>"""
    assert html.extract(html.decode(page)) == "The Head\n\nOne two three.\n\nWith a link.\n\n  • Novel\n  • Tale"
    assert html.decode("<p>café".encode("cp1252")) == "<p>café"
    assert html.extract("") == ""


def test_html_column(spark):
    d = spark.createDataFrame([(1, bytearray(b"<p>a<p>b")), (2, None)], "page_id long, b binary")
    assert [r[0] for r in d.select(html.extract_text("b")).collect()] == ["a\n\nb", None]
