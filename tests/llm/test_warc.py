from __future__ import annotations

import hashlib
from collections import Counter

import zstandard

from ridelens.llm import warc as W
from tests.llm.conftest import SF


def brute(pages):
    top, n = {}, Counter()
    for i, html in pages:
        p = (html or "").encode()
        if len(p) >= 1000:
            n[p] += 1
            if i is not None:
                top[p] = max(top.get(p, i), i)
    out = []
    for i, html in pages:
        p = (html or "").encode()
        revisit = n[p] > 1 and p in top and i != top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response",
                    top[p] if revisit else None))
    return Counter(out)


def rows(df):
    assert df.where("NOT payload_ok").isEmpty()
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in df.collect())


def test_round_trip(spark, tmp_dir):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html"))  # every page twice
    index = W.write_warc(pages, tmp_dir)
    assert rows(W.read_warc(index)) == brute([(r[0], r[2]) for r in pages.collect()])
    # an index row leads to its record, with the whole payload for responses
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in index.limit(20).collect():
        rec = W.Bundle(r["path"]).record(r["frame"], r["offset"], r["length"])
        assert rec["fields"]["WARC-Record-ID"] == r["record_id"] == f"<urn:page:{r['page_id']}>"
        if rec["fields"]["WARC-Type"] == "response":
            assert rec["payload"].decode() == html[r["page_id"]]
        else:
            assert rec["payload"] == b"" and rec["fields"]["WARC-Refers-To"] == f"<urn:page:{r['page_id'] + 1000}>"


def test_edges(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 4_000)
    monkeypatch.setattr(W, "BUNDLE_BYTES", 20_000)
    big = "é" * 600  # 1200 bytes
    data = [(1, "http://a/ü\r\nX: y", big), (2, None, big), (2, "http://b", big), (None, "http://c", big),
            (3, "u", None), (4, "u", ""), (5, "u", "é" * 400), (6, "u", "é" * 400), (None, "u", "x" * 2000),
            (None, "u", "x" * 2000), (2**60 + 1, "u", "\r\n\r\nWARC/1.1\r\n" * 500), (7, "u", "y" * 50_000),
            (8, "u", "a" * 999), (9, "u", "a" * 999)]
    df = spark.createDataFrame([d + ("x", "y") for d in data],
                               "page_id long, url string, html string, digest string, path string")
    assert rows(W.read_warc(W.write_warc(df, tmp_dir))) == brute([(i, h) for i, _, h in data])
    assert W.read_warc(W.write_warc(df.limit(0), tmp_dir)).count() == 0


def test_bundle_is_plain_zstandard(tmp_dir):
    w = W.BundleWriter(tmp_dir)
    parts = [bytes([65 + k]) * 700_000 for k in range(4)]
    spots = [w.add(p) for p in parts]
    w.close()
    assert spots == [(0, 0), (1, 0), (2, 0), (3, 0)]
    with open(w.uri, "rb") as f:  # a reader that knows nothing of the table skips it
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(parts)
    assert W.Bundle(w.uri).frame(2) == parts[2]
