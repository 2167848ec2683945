import gzip
import hashlib
import random

import pytest

from groundline.llm import warc


def record(i, payload=b"<p>hi</p>", kind="response", to=None):
    return warc.encode(i, f"http://x/{i} y", kind, to, payload, hashlib.sha1(payload).hexdigest(), len(payload))


def read(data):
    out, gaps = [], []
    for r, g in warc.salvage(data):
        (out if r else gaps).append(r or g)
    return [r["page_id"] for r in out], [g[:2] for g in gaps]


def test_members_are_gzip():
    rows = [record(i, b"x" * i) for i in range(5)]
    assert gzip.decompress(b"".join(map(warc.compress, rows))) == b"".join(rows)


@pytest.mark.parametrize("plain", [True, False])
def test_salvage(plain):
    rng = random.Random(7)
    rows = [record(i, bytes(rng.choice(b"abc\r\n") for _ in range(rng.randint(0, 300)))) for i in range(12)]
    parts = rows if plain else [warc.compress(r) for r in rows]
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    whole = b"".join(parts)
    assert read(whole) == (list(range(12)), [])
    cut = whole[:-5]
    assert read(cut) == (list(range(11)), [(starts[11], len(cut))])
    junk = whole[:starts[4]] + b"garbage WARC/1.1 \x1f\x8b\x08 more" + whole[starts[4]:]
    assert read(junk) == (list(range(12)), [(starts[4], starts[4] + len(junk) - len(whole))])
    for hurt in (0, 3, 7):
        at = starts[hurt] + (len(parts[hurt]) - 6 if plain else 30)
        bad = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1:]
        if plain and rows[hurt].endswith(b"\r\n\r\n\r\n\r\n"):
            continue
        found, gaps = read(bad)
        assert found == [i for i in range(12) if i != hurt] and gaps == [(starts[hurt], starts[hurt + 1])]
    missing = whole[:starts[2]] + whole[starts[2] + 20:]
    assert read(missing)[0] == [i for i in range(12) if i != 2]


def test_a_large_member_keeps_its_last_byte(spark, tmp_path):
    big = random.Random(1).randbytes(1 << 20).hex() * 9
    df = spark.createDataFrame([(1, "http://big", big), (2, "http://small", "s")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    found = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert set(found) == {1, 2} and found[1]["payload"].decode() == big and all(r["reason"] is None for r in found.values())


def test_round_trip(spark):
    long, other = "é" * 500, "b" * 1000
    pages = [(1, "u", long), (5, "u 1", long), (3, None, long), (2, "v", "a" * 999), (4, "v", "a" * 999), (6, "w", None), (7, "w", ""), (8, "x\r\ny", other), (None, "n", other), (9, "z", "WARC/1.1\r\n\r\n\r\n" * 80), (5, "u 1", long), (10, "e", "x\ud800"[:1])]
    df = spark.createDataFrame([(*p, 1, "r") for p in pages], "page_id long, url string, html string, payload int, record_type string")
    rows = warc.round_trip(df, archive_bytes=700).collect()
    first = {long: 5, other: 8}
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html in first and i != first[html]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_have_their_names_and_sizes(spark, tmp_path):
    noise = random.Random(5)
    df = spark.createDataFrame([(i, "u", noise.randbytes(400).hex()) for i in range(60)], "page_id long, url string, html string").coalesce(2)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=4000)
    files = [f for f in (tmp_path / "w").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    assert all(f.name.endswith(".warc.gz") and f.stat().st_size <= 4100 for f in files) and len(files) > 5
    assert sum(len(gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\n")) - 1 for f in files) == 60
    (files[0].parent / f".{files[0].name}.crc").unlink()
    files[0].write_bytes(files[0].read_bytes()[:100])
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sum(r["reason"] is not None for r in rows) == 1


def test_round_trip_leaves_nothing_and_raises_on_damage(spark, monkeypatch):
    from groundline.sources import scratch

    scratch.clear(spark)
    df = spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string")
    path = warc.round_trip(df).select("path").first()[0]
    assert scratch.clear(spark) >= 1
    import os

    assert not os.path.exists(path.removeprefix("file:"))
    monkeypatch.setattr(warc, "compress", lambda record: b"\x1f\x8b\x08 broken")
    with pytest.raises(Exception, match="damaged archive"):
        warc.round_trip(df).collect()


def test_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "w"))
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in warc.read_archives(spark, str(tmp_path / "w")).collect():
        assert r["reason"] is None and (r["record_type"] == "revisit" or r["payload"].decode() == html[r["page_id"]])
