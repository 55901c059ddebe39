import pytest

from siltworks.llm import personal as Q, toxic as T


def test_toxic_held_out(spark, tiny):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    tagger = T.train(docs, labels)
    rows = [
        (1, "We met at noon. Shut up, you stupid bastard. The bus was late.", "a"),
        (2, "The farmers shot the vermin that ate the grain. The report was short.", "a"),
        (3, None, None), (4, "", "b"), (5, "You are a pathetic l-o-s-e-r and an 1diot.", "b"),
        (6, "The museum shows a nude figure carved from stone.", "b"), (5, "You are a pathetic l-o-s-e-r and an 1diot.", "b"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in T.score(d, tagger).collect()}
    assert got[1].score >= 0.5 and got[5].score >= 0.5
    assert got[2].score < 0.5 and got[6].score < 0.5 and got[3].score == 0 and got[4].score == 0
    s = got[1].spans[0]
    assert "bastard" in rows[0][1][s.start_pos : s.end_pos] and "noon" not in rows[0][1][s.start_pos : s.end_pos]
    rates = {r.source: (r.docs, r.toxic_docs) for r in T.rates(d, tagger).collect()}
    assert rates == {"a": (2, 1), "b": (4, 2), None: (1, 0)}
    assert T.score(d.limit(0), tagger).count() == 0


def test_tagger_without_labels():
    t = T.fit([], [])
    (a, _), (b, _) = T.score_texts(["You are a worthless piece of trash, go kill yourself.", "A group of volunteers cleaned the lighthouse on Monday."], t)
    assert a >= 0.5 > b


def test_disguises():
    assert T.undisguise("i.d.i.o.t") == ("idiot", True) and T.undisguise("sh1thead")[0] == "shithead"
    assert T.undisguise("b*tch") == ("bitch", True) and T.undisguise("2nd") == ("2nd", False)


ITEMS = [
    ("Write to mara.fen+x@post.example.org now", [("email", "mara.fen+x@post.example.org")]),
    ("Write to MARA.Fen (at) post (dot) example now", [("email", "MARA.Fen (at) post (dot) example")]),
    ("x AT post DOT brindle DOT example", [("email", "x AT post DOT brindle DOT example")]),
    ("He paid 3 @ 98.50 each, see @media", []),
    ("call (802)-555-0109 or +44 20 7946 0382 or 01 99 00 87 40", [("phone", "(802)-555-0109"), ("phone", "+44 20 7946 0382"), ("phone", "01 99 00 87 40")]),
    ("rufen Sie (030) 23125-694 an, o llame al 995 55 18 31", [("phone", "(030) 23125-694"), ("phone", "995 55 18 31")]),
    ("Order 44785912, ticket #2429811, ISBN 978-0-47-740368-3, 192.0.2.68, version 3.31.46", []),
    ("number 913-23-6943 and QQ 08 54 54 B and DNI 99343476J", [("id_number", "913-23-6943"), ("id_number", "QQ 08 54 54 B"), ("id_number", "99343476J")]),
    ("lautet 66 146 055 456. est le 2 28 08 99 152 854 76.", [("id_number", "66 146 055 456"), ("id_number", "2 28 08 99 152 854 76")]),
    ("to Flat 5, 158 Canal Walk. We met on Larkspur Lane, close to Heron Street.", [("address", "Flat 5, 158 Canal Walk")]),
    ("an Mühlenstraße 79a, 01226 X. im Lindenweg, nahe der Rosengasse.", [("address", "Mühlenstraße 79a")]),
    ("The form was signed by Tobin van der Quill on Monday", [("name", "Tobin van der Quill")]),
    ("My name is ZELLBRÜCK, Nadja and", [("name", "ZELLBRÜCK, Nadja")]),
    ("signed by P. O’Darragh-Pell today. We saw Port Tavish.", [("name", "P. O’Darragh-Pell")]),
    ("|||EMAIL_ADDRESS||| and the Northmoor council", []),
]


@pytest.mark.parametrize("text,want", ITEMS)
def test_items(text, want):
    got = Q.find(text)
    for (k, a, _), (wk, w) in zip(got, want):
        assert k == wk and text[a:].startswith(w[:4])
    assert len(got) == len(want)


def test_positions_in_garbled_text():
    t = "Le café est là. " + "My name is Inés Okonvale and so on."
    bad = t.encode().decode("latin-1")
    (k, a, _), = Q.find(bad)
    assert k == "name" and a == bad.index("In")


@pytest.mark.parametrize("n", range(1, 14))
def test_feistel_is_a_permutation(n):
    key = b"k"
    for d in {str(i * 7919 % 10**n).zfill(n) for i in range(50)}:
        e = Q.feistel_digits(d, key, "t")
        assert len(e) == n and Q.feistel_digits(e, key, "t", inverse=True) == d
    if n <= 3:
        assert len({Q.feistel_digits(str(i).zfill(n), key) for i in range(10**n)}) == 10**n


def test_masking_links_equal_values(spark):
    rows = [(1, "call 802-555-0109 on 2024-03-05"), (2, "text 802-555-0109 or 802-555-0110"), (3, None), (4, "none"), (5, "")]
    got = {r.doc_id: r for r in Q.detect(spark.createDataFrame(rows, "doc_id long, text string"), b"a key").collect()}
    a = got[1].masked.split("[PHONE:")[1].split("]")[0]
    assert f"[PHONE:{a}]" in got[2].masked and a.count("-") == 2 and "802-555-0109" not in got[1].masked and "2024-03-05" not in got[1].masked
    assert got[3].masked is None and got[4].masked == "none" and got[5].masked == ""
    f = Q.found(spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.pii_type, r.start_pos) for r in f) == [(1, "phone", 5), (2, "phone", 5), (2, "phone", 21)]


NUMBERS = [
    ("ssn", "123-45-6789"), ("ssn", "915 23 3708"), ("nino", "AB 12 34 56 C"), ("insee", "1 85 05 78 006 084 91"), ("insee", "2 09 11 99 011 017 57"),
    ("tin", "18 982 693 514"), ("dni", "12345678Z"), ("dni", "X1234567L"), ("passport", "X12424712"), ("card", "C07X95771"),
    ("phone", "+33 6 12 34 56 78"), ("phone", "802-555-0109"),
]


@pytest.mark.parametrize("kind, value", NUMBERS)
def test_pseudonyms_keep_the_format_and_can_be_undone_with_the_key(kind, value):
    key = b"a key"
    new = Q.swap_number(kind, value, key)
    assert new != value and Q.swap_number(kind, new, key, inverse=True) == value
    assert len(new) == len(value) and [c.isdigit() for c in new] == [c.isdigit() for c in value]
    if kind != "phone":
        assert dict(Q._ID)[kind].fullmatch(new) and Q.valid(kind, new) == Q.valid(kind, value)
        c, d = (Q.check_part(kind, "".join(x for x in v if x.isalnum())) for v in (value, new))
        assert c is None or (value.replace(" ", "").endswith(c[1])) == new.replace(" ", "").endswith(d[1])
        assert Q.swap_number(kind, new, b"another key", inverse=True) != value


def test_separators_do_not_part_equal_numbers():
    a, b = (Q.swap_number("ssn", v, b"k") for v in ("123-45-6789", "123 45 6789"))
    assert a.replace("-", "") == b.replace(" ", "")


def test_numbers_that_fail_their_check_need_an_announcing_phrase():
    assert not Q.find("We saw 000-12-3456 and 666-12-3456 there, and 123-00-4567 too.")
    assert not Q.find("The part 12345678A was replaced.") and [k for k, _, _ in Q.find("The part 12345678Z was replaced.")] == ["id_number"]
    assert [k for k, _, _ in Q.find("Her security number 000-12-3456 is wrong.")] == ["id_number"]


def test_short_and_unspaced_sentences_are_scored():
    tagger = T.fit([], [])
    abusive = ["Fuck you", "kill yourself", "You idiot.", "你这个白痴。", "去死吧！"]
    harmless = ["Thank you.", "Hello.", "How are you?", "谢谢你。", "这座桥很快就要关闭。", "No."]
    assert [s >= T.THRESHOLD for s, _ in T.score_texts(abusive + harmless, tagger)] == [True] * len(abusive) + [False] * len(harmless)


def test_spans_are_positions_of_the_text_as_given():
    tagger = T.fit([], [])
    t = "Le caf\u00c3\u00a9 est l\u00c3\u00a0.\r\n\r\nYou worthless idiot, fuck you!"
    (_, spans), = T.score_texts([t], tagger)
    assert spans and t[spans[0]["start_pos"] :].startswith("You worthless idiot")


def test_names_in_no_list_are_found_where_something_announces_a_person():
    import random

    rng = random.Random(4)
    first = [a + b for a in ("Ba", "Tor", "Quen", "Sve", "Hal", "Mir") for b in ("lin", "dra", "vik", "neth", "ric", "ola")]
    last = [a + b for a in ("Okon", "Farns", "Quig", "Tremb", "Hadd", "Wyc") for b in ("worth", "ley", "vale", "ecki", "berg", "ano")]
    frames = ["Please write to {}.", "We met {} in town.", "You can contact {} today.", "She spoke with {} about it.", "My name is {} and so on.", "Signed, yours, signed by {}.",
              "Dr. {} came late.", "{} still lives at the mill.", "Mein Name ist {} und mehr.", "Herr {} kam an.", "Madame {} est venue.", "Me llamo {} y vivo.", "They interviewed {} twice.", "Ask for {} there."]
    assert not {Q.fold(w) for w in first} & Q.GIVEN
    hit = n = 0
    for _ in range(300):
        name = f"{rng.choice(first)} {rng.choice(last)}"
        t = rng.choice(frames).format(name)
        n += 1
        hit += ("name", t.index(name), t.index(name) + len(name)) in Q.find(t)
    assert hit >= 0.9 * n
    assert not [x for x in Q.find("We met Northern University staff. Contact National Park rangers. WE MET ON LARKSPUR LANE.") if x[0] == "name"]
