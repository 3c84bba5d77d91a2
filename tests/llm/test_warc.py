import hashlib
import random

import duckdb
import pytest
import zstandard

from morphlake.llm import queries, warc


def rows():
    rng = random.Random(4)
    pages = ["<html>" + "".join(rng.choice(["<p>", "word ", "é", "\r\n\r\n", "WARC/1.1"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    out = [(i, f"http://h/{i}\r\nX: y", pages[i % 45]) for i in range(60)]
    return out + [(60, None, None), (61, "", ""), (62, "u", "x" * 99), (63, "u", "x" * 99), (64, "u", "x" * 100), (65, "ü", "x" * 100), (66, "u", "é" * 50), (67, "u", "é" * 50), (68, "u", "y" * 400_000)]


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    first = {}
    for i, _, h in data:
        first.setdefault((h or "").encode(), i)
    for i, _, h in data:
        b = (h or "").encode()
        back = len(b) >= 100 and first[b] != i
        assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if back else "response", first[b] if back else None), i
    pages = df.toPandas()  # noqa: F841
    want = duckdb.sql(queries.oracle_sql()["op3_warc_dictionary"]).fetchall()
    assert sorted(want, key=str) == sorted(((k, *v) for k, v in got.items()), key=str)
    archives = warc.write_archives(df, archive_bytes=2000)
    assert archives.count() > 3
    texts = {r.id: bytes(r.payload).decode() for r in warc.read_archives(archives, payloads=True).collect() if r.record_type == "response"}
    assert all(texts[i] == (h or "") for i, _, h in data if i in texts) and len(texts) > 45


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "a" * 200), (3, "u", "a" * 200), (3, "u", "a" * 200)], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.record_type) for r in warc.round_trip(df).collect()), key=str) == [(3, "response"), (3, "response"), (None, "revisit")]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damage_is_found():
    frame = lambda raw: zstandard.ZstdCompressor().compress(raw)
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [r["payload"] for r in warc.records_of(frame(good) * 2)] == [b"payload"] * 2
    for bad in (frame(good)[:-3], frame(good) + b"junk", frame(good.replace(b"Length: 7", b"Length: 8")), frame(good.replace(b"payload\r", b"payloae\r")), frame(good[:-2]), frame(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    with pytest.raises(ValueError):
        list(warc.records_of(warc.leading_frame(b"x" * 90)[:20]))
