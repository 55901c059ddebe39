import pytest

from siltworks.llm import encoding as E, garbled as G

CLEAN = [
    "Le château restauré près de la rivière accueille des visiteurs après la fête d’été.",
    "Die Mühle am Bach bleibt für alle geöffnet, während draußen Schnee fiel.",
    "El jardín botánico queda cerca de Peñablanca, ¿por qué cerraron la panadería?",
    "ATENÇÃO: a estação antiga NÃO abre em janeiro; São Averil fica à direita.",
    "Мы провели неделю в городе, и нам очень понравилось. Говорят, что новый мост скоро откроют.",
    "我们在月港住了一个星期，非常喜欢社区诊所。听说老车站很快就要关闭。",
    "It’s a pity — the café wasn’t “open” on Monday.",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_kept(text):
    assert E.light_repair(text) == text


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("wrong", ["latin-1", "cp437", "cp1251", "mac_roman"])
def test_round_trip(text, wrong):
    try:
        bad = text.encode("utf-8").decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("the table leaves bytes undefined")
    assert E.light_repair(bad) == text


def test_twice_and_references():
    bad = CLEAN[1].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert E.light_repair(bad) == CLEAN[1]
    refs = "".join(f"&#{ord(c)};" if c > "\x7f" else c for c in "caf" + "é".encode().decode("latin-1") + " noir")
    assert E.light_repair(refs) == "café noir"
    assert E.light_repair("AT&#38;T") == "AT&#38;T"


def test_cyrillic_tables():
    t = CLEAN[4]
    assert E.light_repair(t.encode("koi8-r").decode("cp1251")) == t
    assert E.light_repair(t.encode("cp1251").decode("koi8-r")) == t


def test_model_and_repair(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(70)]
    bad = CLEAN[0].encode("utf-8").decode("cp1252", errors="replace")
    rows += [(100, bad), (101, None), (102, ""), (103, "broken � here"), (104, CLEAN[2].encode().decode("latin-1")), (104, CLEAN[2].encode().decode("latin-1"))]
    d = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, garbled long")
    model, margin = G.train_model(d)
    got = {r.doc_id: (r.garbled, r.restored) for r in G.repair_documents(d, model, margin).collect()}
    assert all(not got[i][0] for i in range(70))
    assert got[101] == (False, None) and got[102] == (False, "")
    assert got[100][0] and got[103] == (True, "broken � here")
    assert got[104] == (True, CLEAN[2])


def test_pages(spark):
    body = lambda t: f"<html><meta charset=utf-8><p>{t}</p>"
    rows = [
        (1, "response", "utf-8", body(CLEAN[0]).encode()),
        (2, "response", "WINDOWS-1252", body(CLEAN[0]).encode()),
        (3, "response", None, body(CLEAN[1]).encode("cp1252")),
        (4, "response", "windows-1252", body(CLEAN[1]).encode("cp1252")),
        (5, "request", "utf-8", b"\xff"),
        (6, "response", "utf-8", None),
        (7, "response", "nonsense", b"plain"),
        (7, "response", "nonsense", b"plain"),
    ]
    p = spark.createDataFrame([(i, k, c, None if b is None else bytearray(b)) for i, k, c, b in rows], "page_id long, warc_type string, charset string, html_bytes binary")
    d = spark.createDataFrame([(i, CLEAN[i % len(CLEAN)]) for i in range(70)], "doc_id long, text string")
    got = sorted((r.table_name, r.record_id) for r in G.found(d, p).collect())
    assert got == [("pages", 2), ("pages", 3)]
    assert G.found(d.limit(0), p.limit(0)).count() == 0


def test_margin_is_set_on_every_span_of_every_record(spark, monkeypatch):
    """A clean span with a high gain counts wherever it stands: late in a text, or in a page."""
    plain = E.best_span
    monkeypatch.setattr(E, "best_span", lambda s, a, b, m: (s, 7.0 if s == "ŵ" else 0.5 if s == "é" else 100.0))
    model = E.CharModel(__import__("numpy").zeros(1 << E.BI_BITS), __import__("numpy").zeros(1 << E.TRI_BITS), {})
    top, hist = G._span_gains(["é a " * 200 + "ŵ", None, "ascii", "é b " * 100], model, {})
    assert top == 7.0 and sum(hist.values()) == 301
    monkeypatch.setattr(E, "best_span", plain)
    d = spark.createDataFrame([(i, "plain ascii") for i in range(5)], "doc_id long, text string")
    page = bytearray(f"<p>{CLEAN[0]}</p>".encode())
    p = spark.createDataFrame([(1, "response", "utf-8", page)], "page_id long, warc_type string, charset string, html_bytes binary")
    seen = []
    monkeypatch.setattr(G, "validate_margin", lambda texts, m: seen.append(texts.where("_t LIKE '%château%'").count()) or 4.0)
    G.train_model(d, p)
    assert seen == [1]
