import random

import pytest

from siltworks.plans import catalog

SYLLABLES = "ba ke li mo nu pra ste vil dor gan".split()
WORDS = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES[:5]]


@pytest.fixture
def crawl(spark, tmp_path):
    """Runs the registered pipeline on rows of ``text, lang, quality, toxic``."""

    def run(rows):
        rng = random.Random(7)
        # Documents that the older scorer's log calls NSFW; all must go.
        bad = [(1000 + i, text(rng, NSFW), "en", "s1") for i in range(12)]
        spark.createDataFrame([(i, t, k, "s1") for i, (t, k, _, _) in enumerate(rows)] + bad, "doc_id long, text string, lang string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
        labels = [(i, q, x) for i, (_, _, q, x) in enumerate(rows) if q is not None]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        seen = [(i, "nsfw", "non-nsfw") for i in range(len(rows))] + [(i, "nsfw", "__label__nsfw") for i, _, _, _ in bad]
        spark.createDataFrame(seen, "doc_id long, model string, label string").write.parquet(f"{tmp_path}/predictions.parquet")
        return {r.doc_id for r in catalog.QUERIES["crawl_pipeline"](spark, str(tmp_path)).collect()}

    return run


FINE = "the council said that most people in the town were pleased with the new bridge and the old road near it".split()
TOXIC = "you filthy scum and vermin are loathsome worthless trash so shut up subhuman pigs because nobody wants stupid idiots here".split()
NSFW = "watch hot naked babes live on cam with hardcore porn videos and free xxx sluts in uncensored nude adult sex shows of tonight".split()
ADS = "click here to buy cheap pills online now best price free offer order today big discount final sale while stocks last".split()


def text(rng, phrase):
    return " ".join(rng.sample(WORDS, 40) + phrase)


def test_pipeline_drops_toxic_and_bad_documents(crawl):
    rng = random.Random(5)
    kinds = [(FINE, 1, 0), (TOXIC, 1, 1), (ADS, 0, 0)]
    rows = [(text(rng, m), "en", q, x) for _ in range(20) for m, q, x in kinds]
    # Unrated documents are judged too.
    rows += [(text(rng, m), "en", None, None) for _ in range(3) for m, _, _ in kinds]
    got = crawl(rows)
    assert got == {i for i in range(len(rows)) if i % 3 == 0}


def test_pipeline_identifies_the_language(crawl):
    rng = random.Random(6)
    german = "der stadtrat sagte am montag dass die alte brücke wegen der arbeiten noch bis zum frühling geschlossen bleibt".split()
    bad = [(text(rng, ADS), "en", 0, 0), (text(rng, TOXIC), "en", 1, 1)] * 4
    en = [" ".join(rng.sample(FINE, 20) + rng.sample(WORDS, 14) + rng.sample(FINE, 20)) for _ in range(30)]
    de = [" ".join(rng.sample(german, 16) + rng.sample(WORDS, 14) + rng.sample(german, 16) + rng.sample(german, 16)) for _ in range(30)]
    rows = [(t, k, 1, 0) for t, k in zip(en, ["en"] * 22 + ["EN", "en-GB", "en_US", None, "", "und", "de", "fr"])]
    rows += [(t, k, 1, 0) for t, k in zip(de, ["de"] * 28 + ["en", "zh"])]
    assert crawl(rows + bad) == set(range(30))
