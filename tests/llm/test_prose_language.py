import numpy as np
import pytest

from siltworks.llm import crf, language as L, prose as P

PROSE = {
    "en": "The council said on Monday that the bridge would be closed for repairs. Most people in the town were not pleased. They will have to use the old road until the work is done.",
    "de": "Der Stadtrat sagte am Montag, dass die Brücke wegen der Arbeiten geschlossen wird. Die meisten Leute in der Stadt waren nicht froh darüber.",
    "fr": "Le conseil a dit lundi que le pont sera fermé pour les travaux. La plupart des gens de la ville ne sont pas contents de cette nouvelle.",
    "es": "El ayuntamiento dijo el lunes que el puente se va a cerrar por las obras. La mayoría de la gente del pueblo no está contenta con esta noticia.",
    "pt": "A câmara disse na segunda que a ponte vai fechar por causa das obras. A maioria das pessoas da cidade não está contente com isso.",
    "ru": "Городской совет сказал, что мост закроют из-за ремонта. Многие люди в городе не были рады этому.",
    "zh": "市政府说，因为道路施工，那座桥很快就要关闭。附近的居民都不太高兴，他们还要等一个月。",
}
JUNK = {
    "list": "\n".join(f"* {n} cups copper saddle" for n in range(30)),
    "table": "\n".join(f"name {n}\t{n * 7}\t3.5\tyes" for n in range(30)),
    "code": "def f(x):\n    return [y for y in x if y]\n" * 10,
    "log": "1742716997 WARN w17 0x802df96e rc=163 724979us\n" * 20,
    "noise": "/|<|*->\\<~|^#>>*-= +-=\\=.|#\\=:^^^#~\n" * 10,
    "ads": "cheap saddle resin buy solder online 30541 best price Northmoor!\n" * 12,
    "salad": "the of and window her paper to if train market between.\nher the is for by with from winter letter are.\n" * 8,
    "inline": ", ".join(f"El museo regional Villa{n}" for n in range(60)),
}


@pytest.mark.parametrize("k", sorted(PROSE))
def test_prose_is_prose(k):
    import textwrap

    t = PROSE[k] + " " + PROSE[k]
    assert P.is_prose(t) and P.is_prose(t.upper())
    assert P.is_prose("\n".join(textwrap.wrap(t, 40)))
    assert P.is_prose(t + "\n* one item\n* two items")
    assert P.is_prose(t.encode("utf-8").decode("latin-1"))


@pytest.mark.parametrize("k", sorted(JUNK))
def test_junk_is_not(k):
    assert not P.is_prose(JUNK[k])
    assert not P.is_prose(PROSE["en"][:60] + ".\n" + JUNK[k])


def test_stats_edges(spark):
    rows = [(1, None, 5), (2, "  ", 5), (3, PROSE["en"], 5), (3, PROSE["en"], 5), (4, "word " * 200_000, 5), (5, "\r\r", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = P.text_stats(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].reasons == ["empty"] and by[1].is_prose is None and by[2].n_words == 0
    assert by[3].is_prose and by[4].n_words == 200_000 and "many_words" in by[4].reasons
    assert sorted(r.doc_id for r in P.found(d).collect()) == [4]
    assert P.found(d.limit(0)).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    K, lens = 3, [4, 2, 1]
    trans, start = rng.normal(size=(K, K)), rng.normal(size=K)
    em = rng.normal(size=(len(lens), 4, K))
    m, _, z = crf.forward_backward(em, np.array(lens), trans, start)
    m2 = crf.posterior(np.ascontiguousarray(em.transpose(1, 0, 2)), np.array(lens), trans, start)
    for b, n in enumerate(lens):
        want, tot = np.zeros((n, K)), 0.0
        for path in itertools.product(range(K), repeat=n):
            s = start[path[0]] + em[b, 0, path[0]] + sum(trans[path[t - 1], path[t]] + em[b, t, path[t]] for t in range(1, n))
            w = np.exp(s)
            tot += w
            for t, k in enumerate(path):
                want[t, k] += w
        assert np.allclose(m[b, :n], want / tot) and np.isclose(z[b], np.log(tot))
        assert np.allclose(m2[:n, b], want / tot)


@pytest.fixture(scope="module")
def model():
    return L.fit([(k, " ".join([t] * 3)) for k, t in PROSE.items()] * 3)


def test_languages_and_stretches(spark, model):
    mixed = PROSE["en"] + "\n\n" + PROSE["ru"] + "\n\n" + PROSE["de"]
    rows = [(i, t) for i, t in enumerate(PROSE.values())] + [(20, mixed), (21, None), (22, ""), (23, PROSE["fr"].encode().decode("latin-1")), (24, "12345")]
    got = {r.doc_id: r for r in L.detect(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, k in enumerate(PROSE):
        assert got[i].langs == [k] and got[i].confidence > 0.8
    assert set(got[20].langs) == {"en", "ru", "de"} and [s.lang for s in got[20].segments] == ["en", "ru", "de"]
    assert (got[21].lang, got[22].lang, got[21].confidence) == ("und", "und", 0.0)
    assert got[23].langs == ["fr"] and got[24].lang == "und"


def test_found(spark):
    rows = [(i * 10 + j, t + " " + t, k) for i, (k, t) in enumerate(PROSE.items()) for j in range(4)]
    rows += [(900, PROSE["en"] + PROSE["en"], "fr"), (901, PROSE["en"], "EN-gb"), (902, PROSE["en"], " und "), (903, PROSE["en"], None), (904, JUNK["code"], None), (905, PROSE["en"] + "\n\n" + PROSE["de"], "en"), (905, PROSE["en"] + "\n\n" + PROSE["de"], "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang) for r in L.found(d).collect())
    assert got == [(900, "en"), (902, "en"), (903, "en"), (905, "de"), (905, "en")]
    assert L.found(d.limit(0)).count() == 0
