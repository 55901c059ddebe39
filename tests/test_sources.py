import gzip

import numpy as np

from siltworks.sources import files
from siltworks.streaming.rowlocal import clean_stream


def record(kind, body, url="https://a.example/"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_and_broken_tail(spark, tmp_path):
    files.register(spark)
    good = record("warcinfo", b"x") + record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi") + record("conversion", "déjà".encode())
    (tmp_path / "a.warc").write_bytes(good)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("conversion", b"two") + record("conversion", b"lost")[:-8]))
    d = spark.read.format("warc").load(f"{tmp_path}/*.warc*")
    got = sorted((r.warc_type, bytes(r.payload)) for r in d.where("warc_type <> 'broken'").collect())
    assert d.where("warc_type = 'broken'").count() == 1
    assert got == [("conversion", b"d\xc3\xa9j\xc3\xa0"), ("conversion", b"two"), ("response", b"<p>hi"), ("warcinfo", b"x")]
    assert spark.read.format("warc").load(f"{tmp_path}/none*").count() == 0


def test_warc_goes_on_after_broken_records(tmp_path):
    from siltworks.sources import warc

    ok = [record("conversion", f"text {i}\nand more".encode()) for i in range(4)]
    short = record("conversion", b"x" * 50).replace(b"Content-Length: 50", b"Content-Length: 20")
    long = record("conversion", b"y" * 50).replace(b"Content-Length: 50", b"Content-Length: 5000")
    headless = b"WARC/1.0\r\nWARC-Type: conversion\r\n\r\n"
    bad_size = record("conversion", b"z").replace(b"Content-Length: 1", b"Content-Length: one")
    p = tmp_path / "a.warc"
    p.write_bytes(b"junk line\r\n" + ok[0] + headless + ok[1] + bad_size + short + ok[2] + long + ok[3])
    got = list(warc.records(str(p)))
    assert [b for _, k, b, _ in got if k == "conversion" and b.startswith(b"text")] == [f"text {i}\nand more".encode() for i in range(4)]
    assert sum(k == "broken" for _, k, _, _ in got) >= 4
    z = tmp_path / "b.warc.gz"
    z.write_bytes(gzip.compress(ok[0] + ok[1])[:-12])
    assert [k for _, k, _, _ in warc.records(str(z))][-1:] == ["broken"]
    (tmp_path / "e.warc").write_bytes(b"")
    assert list(warc.records(str(tmp_path / "e.warc"))) == []


def test_settings_and_metadata(spark, tmp_path):
    files.write_metadata(spark, {"docs": 3, "name": "é"}, str(tmp_path / "m"))
    assert files.read_settings(spark, str(tmp_path / "m")) == {"docs": 3, "name": "é"}


def test_models_are_saved_and_loaded(spark, tmp_path):
    from siltworks.operators import models

    rows = spark.createDataFrame([(i, "good text here" if i % 2 else "bad words there", str(i % 2)) for i in range(20)], "doc_id long, text string, label string")
    models.save(models.train_text_classifier(rows), str(tmp_path / "model"))
    got = models.predict(models.load(str(tmp_path / "model")), rows).collect()
    assert all(r.pred.label == r.label for r in got)


def test_npy_round_trip(spark, tmp_path):
    files.register(spark)
    d = spark.createDataFrame([(list(range(65530, 65536)),), ([1, 2],), ([],)], "tokens array<int>").coalesce(1)
    d.selectExpr("'' AS path", "0L AS start", "tokens").write.format("npy").mode("append").save(str(tmp_path / "t"))
    assert np.load(tmp_path / "t" / "shard_00000.npy").tolist() == [*range(65530, 65536), 1, 2]
    back = spark.read.format("npy").option("chunk", "3").load(str(tmp_path / "t")).orderBy("start").collect()
    assert [x for r in back for x in r.tokens] == [*range(65530, 65536), 1, 2]


def test_text_json_csv(spark, tmp_path):
    (tmp_path / "m.txt").write_text("one <|endoftext|>\n\n two<|endoftext|><|endoftext|>\n<|endoftext|>\n")
    assert sorted(r.text for r in files.marked_documents(spark, str(tmp_path / "m.txt")).collect()) == ["one", "two<|endoftext|>"]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write('{"text": "a"}\n{broken\n{"other": 1}\n{"text": "b"}\n')
    assert sorted(r.text for r in files.json_lines(spark, str(tmp_path / "x.json.gz")).collect()) == ["", "a", "b"]
    (tmp_path / "r.csv").write_text("lr,loss\n0.1,2.5\nlr,loss\n0.2,\n")
    assert [(r.lr, r.loss) for r in files.csv_rows(spark, str(tmp_path / "r.csv"), "lr double, loss double").orderBy("lr").collect()] == [(0.1, 2.5), (0.2, None)]
    (tmp_path / "w.txt").write_bytes(b"a\r\nb\rc")
    assert files.whole_files(spark, str(tmp_path / "w.txt")).first().text == "a\nb\nc"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(str(i),) for i in range(25)], "text string").coalesce(1)
    files.write_batches(d, str(tmp_path / "b"), 10)
    assert len(list((tmp_path / "b").glob("*.txt"))) == 3
    assert sorted(int(r.text) for r in files.marked_documents(spark, str(tmp_path / "b")).collect()) == list(range(25))
    files.write_labels(d.limit(1).selectExpr("'pos' AS label", "text"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "__label__pos 0"


def test_urls(spark):
    d = spark.createDataFrame([("https://h/books/a.json.gz",), ("https://h/c4/b.json.gz",), ("https://h/cc_en/c.json.gz",)], "url string")
    assert [(r.url[-9], r.t) for r in files.usable_urls(d).select("url", files.url_type().alias("t")).collect()] == [("a", "books")]


def test_stream_equals_batch(spark, tiny, tmp_path):
    src = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    src.write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).select("doc_id").writeStream.format("memory").queryName("clean_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("clean_rows").collect()) == sorted(r[0] for r in clean_stream(src).select("doc_id").collect())


def test_split_names_and_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "train", "a"), (2, "valid", "b"), (3, "train", "c")], "doc_id long, split string, value string")
    files.write_split(d, str(tmp_path / "s"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "s" / "split=train")).collect()) == ["a", "c"]
    files.write_documents(d.withColumnRenamed("value", "text"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d" / "doc_id=2"), wholetext=True).first()[0].strip() == "b"
    p = spark.createDataFrame([("/x/y/CC-1.warc.wet.gz",), ("plain",)], "path string")
    assert [r[0] for r in p.select(files.batch_name(files.file_stem(F.col("path")), F.lit(7))).collect()] == ["CC-1.warc.wet_batch_007.txt", "plain_batch_007.txt"]
    assert files.existing(p, p.limit(1)).count() == 1
