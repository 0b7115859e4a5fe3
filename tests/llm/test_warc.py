import gzip
import io
import random
import zlib

import pytest

from riskloom.llm import warc
from riskloom.session import scratch_path


def members(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = rng.randbytes(rng.randint(0, 3000))
        if i % 7 == 0:   # a payload that is itself a gzip file, with a magic inside
            payload = gzip.compress(b"WARC/1.0\r\nnot a record" + payload) + warc.MAGIC * 3
        out.append((i, payload))
    return out


@pytest.mark.parametrize("step", [1, 7, 100, 4096, 1 << 20])
def test_ranges_own_each_record_once(step):
    recs = members(12 if step == 1 else 40)
    raw = b"".join(warc.record_bytes(i, f"http://x/{i}", p, None, True) for i, p in recs)
    f, got = io.BytesIO(raw), []
    for start in range(0, len(raw), step):
        for head, block in warc.scan_range(f, len(raw), start, min(len(raw), start + step)):
            got.append((int(head["warc-record-id"][10:-1]), block.partition(b"\r\n\r\n")[2]))
    assert got == recs


def test_files_are_plain_gzip():
    raw = b"".join(warc.record_bytes(i, None, p, None, True) for i, p in members(5))
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1\r\n") == 5
    assert raw[-1] == 0


def test_long_record_ends_with_an_empty_member():
    raw = warc.record_bytes(1, None, b"a" * (17 << 20), None, True)
    assert raw.endswith(warc.EMPTY_MEMBER) and raw[-1] == 0
    assert len(gzip.decompress(raw)) > 17 << 20
    [(head, block)] = warc.scan_range(io.BytesIO(raw), len(raw), 0, len(raw))
    assert len(block.partition(b"\r\n\r\n")[2]) == 17 << 20


def test_long_members_take_time_in_proportion():
    """A payload of 200 MB and one of 50 MB, compressible and not."""
    import time

    rng = random.Random(5)
    for make in (lambda n: bytes(n), lambda n: rng.randbytes(1 << 20) * (n >> 20)):
        took = []
        for mb in (50, 200):
            raw = warc.record_bytes(1, None, make(mb << 20), None, True) + warc.record_bytes(2, None, b"after", None, True)
            start = time.time()
            got = [(h["warc-record-id"], len(b)) for h, b in warc.scan_range(io.BytesIO(raw), len(raw), 0, len(raw))]
            took.append(time.time() - start)
            assert [i for i, _ in got] == ["<urn:page:1>", "<urn:page:2>"] and got[0][1] > mb << 20
        assert took[1] < 8 * took[0] + 0.5 and took[1] < 15, took


def test_a_magic_by_chance_inflates_little(monkeypatch):
    """Members that are no records are left after their first bytes."""
    bomb = gzip.compress(bytes(50 << 20))
    raw = bomb * 3 + warc.record_bytes(7, None, b"x", None, True)
    inflated = []
    real = zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.z = real(*a)

        def decompress(self, data, n):
            out = self.z.decompress(data, n)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert [h["warc-record-id"] for h, _ in warc.scan_range(io.BytesIO(raw), len(raw), 0, len(raw))] == ["<urn:page:7>"]
    assert sum(inflated) < 10_000


def test_clashing_names(spark):
    df = spark.createDataFrame([(*p, "i", b"p", "d", 9, "x", "y") for p in PAGES],
                               "page_id long, url string, html string, refers_to long, id string, payload binary, d string, _i int, _d string, record string")
    path = scratch_path(spark, "warc")
    warc.write_warc(df, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, path)).collect()]
    assert sorted(got, key=str) == expected(PAGES)


def test_garbage_between_records_is_passed_over():
    a, b = (warc.record_bytes(i, None, b"p%d" % i, None, True) for i in (1, 2))
    raw = b"junk" + warc.MAGIC + a + warc.MAGIC + b"\0\0" + zlib.compress(b"x") + gzip.compress(b"other") + b + b[:30]
    got = [h["warc-record-id"] for h, _ in warc.scan_range(io.BytesIO(raw), len(raw), 0, len(raw))]
    assert got == ["<urn:page:1>", "<urn:page:2>"]


PAGES = [(1, "http://a/é", "x" * 5000, 0), (2, None, "same", 0), (5, "http://b\r\nX: y", "same", 0), (3, "u", None, 0), (4, "u", "", 0),
         (None, "u", "same", 0), (7, "u", "only ünï 🙂", 0), (8, "u", "rep", 0), (8, "u", "rep", 0), (None, "u", "alone", 0)]


def expected(rows):
    best = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if i is not None and (best.get(p) is None or i > best[p]):
            best[p] = i
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        top = best.get(p)
        again = i != top
        out.append((i, len(p), warc.base32_digest(p), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [300, 1 << 24])
def test_written_and_read_back(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, refers_to long").repartition(2)
    path = scratch_path(spark, "warc")
    warc.write_warc(df, path)
    records = warc.read_warc(spark, path, split_bytes=split)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(records).collect()]
    assert sorted(got, key=str) == expected(PAGES)
    texts = {bytes(r.payload).decode() for r in records.filter("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h, _ in PAGES}


@pytest.mark.parametrize("split", [50_000, 1 << 24])
def test_long_urls_are_read_back(spark, split):
    rng = random.Random(3)
    urls = {i: "data:" + "".join(rng.choices("abcdefghijklmnop0123456789", k=n)) for i, n in ((1, 65_000), (2, 70_000), (3, 1 << 20), (4, 3 << 20))}
    df = spark.createDataFrame([(i, u, "same" if i < 3 else f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_warc(df.coalesce(1), path)
    got = warc.page_records(warc.read_warc(spark, path, split_bytes=split)).collect()
    assert sorted((r.page_id, r.target_uri) for r in got) == sorted(urls.items())
    assert {r.page_id: r.refers_to for r in got} == {1: 2, 2: None, 3: None, 4: None}


def test_empty(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_warc(spark, path)).count() == 0
