import hashlib
from collections import defaultdict

import zstandard

from helixframe.llm import warc
from helixframe.llm.queries import op7_warc

from .helpers import SF, empty


def brute(pages, least=1000):
    groups = defaultdict(list)
    for page, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for data, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(data) >= least and i is not None and i < top
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_table(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, op7_warc(spark, SF).collect()), key=str) == brute(pages)


def test_archives(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(2)
    manifest = warc.write(pages)
    assert sum(r["records"] for r in manifest.collect()) == pages.count()
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    for r in warc.read(manifest, with_payload=True).collect():
        assert r["record_type"] == "revisit" and r["payload"] is None or bytes(r["payload"]) == html[r["page_id"]]
    path = manifest.first()["path"].removeprefix("file://")
    head = open(path, "rb").read(8)
    assert int.from_bytes(head[:4], "little") == warc.DICTIONARY_MAGIC
    data = open(path, "rb").read()
    size = int.from_bytes(head[4:], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert dictionary.dict_id() and zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 3000)
    monkeypatch.setattr(warc, "TRAIN_BYTES", 2000)
    big, long = "é<p>" * 400, "x" * 3_000_000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (None, "u", big), (4, "u", None), (5, "u", ""), (6, None, "short"), (7, "u", "short"), (8, "u", long), (9, "u", long)]
    rows += [(20 + i, "u", f"{i}" * (i * 37)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "clash", 2) for r in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)
    manifest = warc.write(pages)
    assert manifest.count() > 3
    assert sorted(map(tuple, warc.read(manifest).collect()), key=str) == brute([(a, c) for a, _, c in rows])
    assert warc.read(warc.write(empty(pages))).count() == 0
