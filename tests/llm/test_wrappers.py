import hashlib

from siltworks.llm import pageparse as W, wrappers as R

P1 = "The council said on Monday that the bridge would be closed for repairs until the spring."
WORDS = "no one two three four five".split()
P2 = "Most people in the town were not pleased, but they will have to use the old road for now."


def page(a, b, extra="", foot="All rights reserved."):
    return (
        f"<!DOCTYPE html><html><head><title>{a}</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>"
        f"<div id=cookie-banner>We use cookies. <button>OK</button></div><div class=css-1a2b3c><div><div class=css-000abc>{a}</div><div class=meta>Published on 1.2.2025</div>{extra}"
        f"<div class=css-00aabb>{b} <a href=z>with a <em>link</em></a> inside&nbsp;it.</div><ul><li>one item</li><li>two items</li></ul></div></div>"
        f"<div class=css-ffffff><div><b>user12</b><p>{P2} I said so.</p></div></div><div style='display:none'>{P1} Hidden.</div><div class=footer>{foot}</div></body></html>"
    )


def test_blocks_are_lenient():
    bs = [b.text for b in W.blocks("<p>a <b>b</b><p>c<br>d<li>e<li>f</ul><td>g<!-- x --><script>y</script>&amp;h")]
    assert bs == ["a b", "c", "d", "e", "f", "g", "&h"]
    assert W.blocks("") == [] and W.blocks("<<<") != None  # noqa: E711


def test_wrapper_generalises():
    a = [("p", 1), ("h", 2), ("q", 3), ("f", 4)]
    b = [("p", 1), ("h", 5), ("q", 3), ("q", 6), ("q", 7), ("f", 4)]
    c = [("p", 1), ("n", 9), ("h", 8), ("q", 3), ("f", 4)]
    w = R.infer([a, b, c])
    kind = {(t.place, t.slot, t.optional, t.repeated) for t in w}
    assert ("h", True, False, False) in kind and ("n", False, True, False) in kind
    assert [t.seen for t in w if t.place == "f"] == [3] and [t.seen for t in w if t.place == "p"] == [3]
    assert R.infer([]) == []


def test_main_body(spark):
    rows = []
    for i in range(6):
        rows.append((i, f"https://h.example/{i}", "h.example", "response", "utf-8", bytearray(page(f"Title number {i}", P1 + f" It costs {WORDS[i]} crowns", "<div class=css-9>Read also: other news</div>").encode())))
    rows += [rows[0], (90, "u", "h.example", "request", None, bytearray(b"<p>x")), (91, "u", None, "response", None, None), (92, "u", None, "response", None, bytearray(f"<h1>Cafe</h1><p>{P1} Déjà vu.".encode("cp1252"))), (93, "u", "e", "response", None, bytearray(b""))]
    p = spark.createDataFrame(rows, "page_id long, url string, host string, warc_type string, charset string, html_bytes binary")
    got = {r.page_id: r.blocks for r in R.main_text(p).collect()}
    assert got[3] == ["Title number 3", P1 + " It costs three crowns with a link inside it.", "one item", "two items"]
    assert got[92] == ["Cafe", P1 + " Déjà vu."] and got[93] == [] and set(got) == {0, 1, 2, 3, 4, 5, 92, 93}
    f = {(r.page_id, r.block_md5) for r in R.found(p).collect()}
    assert (92, hashlib.md5((P1 + " Déjà vu.").encode()).hexdigest()) in f and len([x for x in f if x[0] == 0]) == 4
    assert R.found(p.limit(0)).count() == 0


def hosted(spark, rows):
    return spark.createDataFrame([(i, u, h, "response", "utf-8", bytearray(f"<html><body>{t}</body></html>".encode())) for i, u, h, t in rows], "page_id long, url string, host string, warc_type string, charset string, html_bytes binary")


NOTE = "Our readers keep this small paper alive with gifts and with letters."


def article(i, note=""):
    n = "".join("abcdefghij"[int(x)] for x in str(i))  # digits do not tell texts apart
    ws = [a + n for a in "the river was calm that day and people came to see it from far away".split()]
    return f"<div><p>{' '.join(ws)}.</p><p>Later {' '.join(reversed(ws))} again.</p>{note}</div>"


def test_wrapper_is_inferred_from_all_pages(spark):
    """Rare notices of a large host are template; repeated rows and crawls of a page are not."""
    rows = [(i, f"u{i}", "h", article(i, f"<p>{NOTE}</p>" if i % 30 == 0 else "")) for i in range(90)]
    rows += [rows[1], (200, "u2", "h", article(2)), (300, "x", "few", article(300)), (300, "x", "few", article(300))]
    got = {r.page_id: r.blocks for r in R.main_text(hosted(spark, rows)).collect()}
    assert not any(NOTE in b for b in got.values())
    assert all(len(b) == 2 for b in got.values())


def test_shared_templates_need_no_growing_number_of_hosts(spark):
    rows = [(10 * h + i, f"u{h}.{i}", f"h{h}", article(10 * h + i, f"<p>{NOTE}</p>")) for h in range(2) for i in range(2)]
    rows += [(1000 + h, f"v{h}", f"o{h}", article(1000 + h, f"<p>{NOTE}</p>" if h == 5 else "")) for h in range(3100)]
    d = hosted(spark, rows)
    keys = {r.host: set(r["keys"]) for r in R.host_templates(R._pages(d)).collect()}
    assert R.text_key(NOTE) in keys["o5"] and R.text_key(NOTE) in keys["h0"] and "o6" not in keys
