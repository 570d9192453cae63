import hashlib

import zstandard
from pyspark.sql import functions as F

from starling.llm import warc
from starling.llm.common import fresh_path

LONG = "<p>é</p>" * 40
ROWS = [(5, "http://a", LONG), (3, "http://b\r\nX: y", LONG), (9, None, LONG), (3, "http://b", LONG), (None, "u", LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", "x" * 700_000), (10, "u", "only once " * 20)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def check(rows):
    assert sorted(r["page_id"] or -1 for r in rows) == sorted(r[0] or -1 for r in ROWS)
    html = {i: h or "" for i, _, h in ROWS}
    for r in rows:
        data = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        want = 3 if data == LONG.encode() and r["page_id"] != 3 else None
        assert r["refers_to"] == want and r["record_type"] == ("revisit" if want else "response")


def test_round_trip(spark):
    folder = fresh_path(spark, "warc-test")
    out, index = warc.archive(spark, frame(spark), folder)
    check(out.collect())
    files, path = warc.open_store(folder)
    for r in index.select("bundle").distinct().collect():
        with files.open_input_stream(f"{path}/{r[0]}", compression=None) as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()  # any reader can
        assert plain.startswith(b"WARC/1.1\r\n")
    one = index.where(F.col("page_id") == 8).first()
    assert warc.fetch(index, folder, [one["record_id"]]) == {one["record_id"]: b"x" * 700_000}


def test_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    check(warc.archive(spark, frame(spark))[0].collect())


def test_many_frames_and_bundles(spark, monkeypatch):
    rows = [(i, "u", f"{i} " * 5000) for i in range(120)]
    out, index = warc.archive(spark, frame(spark, rows).coalesce(1))
    assert index.agg(F.max("frame")).first()[0] > 5
    assert {(r["page_id"], r["payload_bytes"]) for r in out.collect()} == {(i, len(h)) for i, _, h in rows}


def test_empty(spark):
    assert warc.archive(spark, frame(spark).limit(0))[0].count() == 0
