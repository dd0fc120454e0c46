import hashlib

import zstandard
from pyspark.sql import functions as F

from foliolens.llm import warc

LONG, OTHER = "<p>é" + "x" * 2000, "<p>" + "y" * 999
PAGES = [
    (1, "http://a/é x", LONG), (2, "http://b/", LONG), (9, "http://c/\r\nX: y", LONG), (3, None, "short"), (4, "http://d", "short"), (5, "http://e", None),
    (6, "http://f", ""), (None, "http://g", LONG), (7, "http://h", OTHER), (8, "http://i", OTHER), (9, "http://c/\r\nX: y", LONG), (10, "http://j", "\r\n\r\nWARC/1.1\r\n" * 500000),
]


def brute():
    last = {}
    for p, _, h in PAGES:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            last[raw] = max(p, last.get(raw, p))
    out = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = raw in last and p != last[raw]
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[raw] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    rows = warc.archived(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == brute()
    assert warc.archived(df.limit(0)).collect() == []


def test_bundles_seek(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i} " + "word " * (i % 700)) for i in range(900)], "page_id long, url string, html string")
    bundles = warc.write(df.repartition(2)).cache()
    content = bundles.first()["content"]
    assert len(warc.frame_table(content)) > 1
    plain = b"".join(warc.read_frame(content, f) for f in warc.frame_table(content))
    assert zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read() == plain
    places = warc.index(bundles).collect()
    assert len(places) == 900
    frames = warc.frame_table(content)
    for p in [p for p in places if p["bundle"] == bundles.first()["bundle"]][:50]:
        headers, payload, _ = warc.parse(warc.read_frame(content, frames[p["frame"]]), p["offset"])
        assert headers["WARC-Record-ID"] == f"<urn:page:{p['record_id']}>" and payload.decode().startswith(f"<p>{p['record_id']} ")
    found = warc.lookup(bundles, spark.createDataFrame([(5,), (77,), (5000,)], "id long")).collect()
    assert sorted((r["id"], bytes(r["payload"])[:5]) for r in found) == [("5", b"<p>5 "), ("77", b"<p>77")]
