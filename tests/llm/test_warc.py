import hashlib
import os

import pytest
import zstandard

from pagelift.llm import warc

PAGES = "page_id long, url string, html string, digest string, n int"
BIG = "<p>" + "x" * 200


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES)


def brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        revisit = len(data) >= 100 and i is not None and min(same) < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/\r\nx", BIG), (1, "http://a/é", BIG), (2, None, BIG), (5, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 60_000), (9, "u", "<p>\r\n\r\nWARC/1.1\r\n" + "y" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100), (None, "u", BIG), (2, None, BIG)]


def test_records(spark):
    got = warc.page_records(pages(spark, ROWS))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute(ROWS)


def test_a_hot_payload(spark):
    rows = [(i, "u", BIG) for i in range(2500)] + [(3000 + i, "u", f"{BIG}{i}") for i in range(50)]
    got = {r["page_id"]: r for r in warc.page_records(pages(spark, rows)).collect()}
    assert sum(r["record_type"] == "response" for r in got.values()) == 51 and got[2499]["refers_to"] == 0


def test_round_trip_and_random_access(spark, tmp_path):
    uri = f"file://{tmp_path}"
    rows = [(i, f"http://e.com/{i}", f"<p>{i}" + chr(97 + i % 26) * (i * 37 % 900)) for i in range(300)]
    index = warc.write_archives(pages(spark, rows), uri, frame_bytes=4000, bundle_bytes=3000)
    whole = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    assert {i: (u, h.encode()) for i, u, h in rows} == {i: (r["url"], bytes(r["payload"])) for i, r in whole.items()}
    some = warc.read_records(index.filter("page_id % 50 = 7")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some) == [(i, h.encode()) for i, _, h in rows if i % 50 == 7]
    named = {r["bundle"] for r in index.select("bundle").distinct().collect()}
    assert len(named) > 1
    for name in named:  # a plain Zstandard reader passes over the seek table
        with open(name.removeprefix("file://"), "rb") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert data.startswith(b"WARC/1.1\r\n")
    frames = index.groupBy("bundle", "frame").count().count()
    assert frames > len(named)


def test_damage_is_seen(spark, tmp_path):
    index = warc.write_archives(pages(spark, [(1, "u", BIG)]), f"file://{tmp_path}")
    (name,) = [n for n in os.listdir(tmp_path) if n.endswith(".zst")]
    data = bytearray((tmp_path / name).read_bytes())
    data[len(data) // 3] ^= 255
    (tmp_path / name).write_bytes(bytes(data))
    with pytest.raises(Exception, match="(?i)decompress|damaged|checksum|zstd"):
        warc.read_archives(index).collect()


def test_empty(spark):
    assert warc.page_records(pages(spark, ROWS).limit(0)).count() == 0
