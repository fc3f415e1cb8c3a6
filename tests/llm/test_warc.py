import gzip
import io
import random

import pytest

from tidewatch.llm import queries, warc


def records(n=6):
    return [warc.record("response", str(i), f"http://x/{i}", p, warc.base32_sha1(p), len(p), None) for i, p in ((i, f"payload {i} WARC/1.1\r\n\r\n".encode() * (i + 1)) for i in range(n))]


def test_round_trip_and_salvage_of_members():
    good = [warc.member(r) for r in records()]
    assert gzip.decompress(b"".join(good)) == b"".join(records())
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 255
    data = b"junk" + good[0] + good[1] + bytes(broken) + good[3][:-9] + good[4] + b"\x1f\x8b\x08" + good[5] + b"tail"
    found = list(warc.salvage(io.BytesIO(data)))
    assert [f["warc-record-id"] for f, *_ in found if f] == [f"<urn:page:{i}>" for i in (0, 1, 4, 5)]
    assert [(s, e) for _, s, e, _ in found][0][0] == 0
    assert all(a[2] == b[1] for a, b in zip(found, found[1:])) and found[-1][2] == len(data)
    assert sum(e - s for f, s, e, _ in found if f is None) == 4 + len(broken) + len(good[3]) - 9 + 3 + 4


def test_salvage_of_plain_records(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 17)
    r = records()
    wrong = r[1].replace(b"payload 1", b"payload X")
    data = r[0] + wrong + r[2] + r[3][:40] + r[4]
    found = list(warc.salvage(io.BytesIO(data)))
    assert [f["warc-record-id"] for f, *_ in found if f] == [f"<urn:page:{i}>" for i in (0, 2, 4)]
    assert [g for f, _, _, g in found if f is None] == ["wrong digest", "bad header"]
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_pages_round_trip(spark):
    rows = [(i, f"http://e/{i}", f"<p>{i % 7}é</p>" * 50, 0) for i in range(40)] + [(100, None, None, 0), (101, "u r", "", 0), (None, "n", "own", 0), (None, "m", "<p>3é</p>" * 50, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    manifest = warc.write(warc.planned(pages), warc.archive_folder(spark))
    got = {(r.record_id, r.uri): r for r in warc.read(manifest).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first.setdefault(h or "", i)
    for i, u, h, _ in rows:
        r = got[None if i is None else str(i), "".join((u or "").split())]
        body = (h or "").encode()
        assert r.payload_digest == warc.base32_sha1(body) and r.payload_bytes == len(body) and r.gap is None
        if first.get(h or "", i) == i:
            assert r.record_type == "response" and bytes(r.payload) == body and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == str(first[h or ""])
    assert warc.read(warc.write(warc.planned(pages.limit(0)), warc.archive_folder(spark))).collect() == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_query_with_null_and_text_ids(spark, tmp_path, kind):
    rows = [(1, "u", "a"), (None, "u", "a"), (None, "v", "b"), (2, "w", None), (3, "w", ""), (3, "w", ""), (2, "u", "a")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(f"cast(page_id as {kind}) page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in queries.op8_warc(spark, str(tmp_path)).collect())
    assert got == sorted([("1", 1, "response", "None"), ("None", 1, "revisit", "1"), ("None", 1, "response", "None"), ("2", 0, "response", "None"), ("3", 0, "revisit", "2"), ("3", 0, "revisit", "2"), ("2", 1, "revisit", "1")])


def test_salvage_of_broken_archives_in_spark(spark, tmp_path):
    rng = random.Random(2)
    want, gaps, names = set(), 0, []
    for k in range(6):
        packed, parts = k % 2 == 0, []
        for i in range(30):
            body = bytes(rng.choices(b"abc \n", k=rng.randint(0, 3000)))
            r = warc.record("response", str(100 * k + i), "u", body, warc.base32_sha1(body), len(body), None)
            r = warc.member(r) if packed else r
            if i % 7 == 3 and len(body) > 10:
                gaps += len(r) - 6
                r = r[:-6]
            else:
                want.add((str(100 * k + i), body))
            parts.append(r)
        (tmp_path / f"{k}.warc").write_bytes(b"".join(parts))
        names.append((f"file://{tmp_path}/{k}.warc",))
    found = warc.read(spark.createDataFrame(names, "archive string"), batch_rows=7)
    assert {(r.record_id, bytes(r.payload)) for r in found.filter("gap is null").collect()} == want
    n = warc.quarantine(found, f"file://{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log/quarantine").collect()
    assert n == len(log) > 12 and sum(r.n_bytes for r in log) == gaps and all(r.reason for r in log)


def test_long_payloads_are_checked_but_not_handed_on(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    body = b"x" * 5000
    good = warc.record("response", "1", "u", body, warc.base32_sha1(body), 5000, None)
    bad = good.replace(b"xxx\r\n\r\n", b"xxy\r\n\r\n")
    for pack in (warc.member, bytes):
        found = list(warc.salvage(io.BytesIO(pack(good) + pack(bad) + pack(good)), largest=1000))
        assert [f and (f["payload"], f["size"], f["digest"]) for f, *_ in found] == [(None, 5000, warc.base32_sha1(body)), None, (None, 5000, warc.base32_sha1(body))]
    assert [g for *_, g in warc.salvage(io.BytesIO(good), header=50)] == ["no header"]


def test_a_page_with_a_very_long_url_comes_back(spark):
    url = "http://a/" + "x" * (2 << 20)
    pages = spark.createDataFrame([(1, url, "<p>one</p>"), (2, "http://b", "<p>two</p>"), (3, url + "y", "<p>one</p>")], "page_id long, url string, html string")
    manifest = warc.write(warc.planned(pages), warc.archive_folder(spark))
    got = {r.record_id: r for r in warc.read(manifest).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].uri == url and got["3"].uri == url + "y" and got["3"].refers_to == "1"
    assert all(r.gap is None for r in got.values())


def test_names_of_file_systems(tmp_path):
    assert warc.located(f"file://{tmp_path}/a")[1] == f"{tmp_path}/a"
    assert "S3" in type(warc.located("s3a://bucket/a?region=us-east-1")[0]).__name__ and warc.located("s3a://bucket/a?region=us-east-1")[1] == "bucket/a"
