import base64
import gzip
import hashlib
import random

from vinterra.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, record string, n int"


def record(i, body=b"<p>x</p>", kind=b"response", extra=b""):
    digest = b"sha1:" + W.sha1_32(body).encode()
    return (
        b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: " % i + digest + b"\r\n" + extra
        + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    )


def read(data):
    got = list(W.salvage(data))
    ids = [h["warc-record-id"] for _, _, h, _, _ in got if h]
    gaps = [(o, n) for o, n, h, _, _ in got if h is None]
    return [int(x[10:-1]) for x in ids], gaps


def test_sound_file_has_no_gaps():
    data = b"".join(record(i, b"body %d" % i) for i in range(20))
    assert read(data) == (list(range(20)), [])
    assert read(b"") == ([], [])


def test_damage_is_quarantined_and_later_records_return():
    parts = [record(i, b"body %d " % i * 30) for i in range(8)]
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    for k in range(8):
        spoilt = list(parts)
        spoilt[k] = spoilt[k][:60] + b"@" + spoilt[k][61:]  # header
        spoilt[k] = spoilt[k][:-20] + b"#" + spoilt[k][-19:]  # block: wrong digest
        assert read(b"".join(spoilt)) == ([i for i in range(8) if i != k], [(starts[k], len(parts[k]))])
    lost = b"".join(parts[:3]) + parts[3][:50] + b"".join(parts[4:])  # bytes missing
    assert read(lost) == ([0, 1, 2, 4, 5, 6, 7], [(starts[3], 50)])
    junk = b"junk" + parts[0] + b"\r\nmore junk" + parts[1] + parts[2][:-9]
    ids, gaps = read(junk)
    assert ids == [0, 1]
    assert gaps == [(0, 4), (4 + len(parts[0]), 11), (15 + len(parts[0]) + len(parts[1]), len(parts[2]) - 9)]


def test_wrong_length_does_not_swallow_the_next_record():
    bad = record(1).replace(b"Content-Length: 8", b"Content-Length: 900")
    assert read(record(0) + bad + record(2))[0] == [0, 2]
    assert read(record(0) + bad.replace(b"900", b"-5") + record(2))[0] == [0, 2]


def test_gzip_members():
    parts = [gzip.compress(record(i, random.Random(i).randbytes(500))) for i in range(6)]
    assert read(b"".join(parts)) == (list(range(6)), [])
    at = len(parts[0]) + len(parts[1])
    spoilt = bytearray(b"".join(parts))
    spoilt[at + 200] ^= 0xFF
    ids, gaps = read(bytes(spoilt))
    assert ids == [0, 1, 3, 4, 5] and gaps == [(at, len(parts[2]))]
    cut = b"".join(parts)[:-30]
    ids, gaps = read(cut)
    assert ids == [0, 1, 2, 3, 4] and gaps[0][0] == sum(map(len, parts[:5]))
    assert read(parts[0] + record(9) + parts[1])[0] == [0, 9, 1]


def test_random_damage_never_loses_an_untouched_record():
    rnd = random.Random(4)
    for _ in range(60):
        parts = [record(i, rnd.randbytes(rnd.randrange(0, 300))) for i in range(10)]
        if rnd.random() < 0.5:
            parts = [gzip.compress(p) for p in parts]
        whole = bytearray(b"".join(parts))
        ends = [sum(map(len, parts[: i + 1])) for i in range(10)]
        a = rnd.randrange(len(whole))
        b = min(len(whole), a + rnd.randrange(1, 200))
        whole[a:b] = rnd.randbytes(b - a)
        ids, gaps = read(bytes(whole))
        untouched = {i for i in range(10) if ends[i] <= a or ends[i] - len(parts[i]) >= b}
        assert untouched <= set(ids)
        assert sum(n for _, n in gaps) + sum(len(parts[i]) for i in ids) == len(whole)


def brute(rows):
    first = {}
    for i, html in rows:
        body = (html or "").encode()
        first[body] = min((first.get(body), i), key=lambda x: (x is None, x))
    out = []
    for i, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = i == first[body]
        out.append((i, len(body), digest, "response" if same else "revisit", None if same else first[body]))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark, tmp_out):
    tricky = "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0 \U0001f600 é\x00\x1f"
    rows = [(3, "u", "same"), (1, "u\r\nX: y", "same"), (2, None, "same"), (4, "", None), (5, "v", ""), (None, "n", "same"), (None, "n", "alone")]
    rows += [(6, "w", tricky), (7, "w", "x" * 300_000), (8, "w", "a\r\n\r\n"), (1, "u", "same"), (9, "w", "﻿bom")]
    pages = spark.createDataFrame([(*r, "d", "r", 1) for r in rows], PAGES)
    path = W.write_warc(pages, tmp_out + "/warc")
    got = W.read_warc(spark, path)
    assert got.where("gap_reason is not null").count() == 0
    assert sorted(map(tuple, W.captures(got).collect()), key=str) == brute([(r[0], r[2]) for r in rows])
    held = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    assert (6, tricky.encode()) in held and (7, b"x" * 300_000) in held and (8, b"a\r\n\r\n") in held


def test_damaged_archive_on_disk(spark, tmp_out):
    import os

    os.makedirs(tmp_out + "/in")
    with open(tmp_out + "/in/a.warc", "wb") as f:
        f.write(record(1) + b"###" + record(2))
    with open(tmp_out + "/in/b.warc.gz", "wb") as f:
        f.write(gzip.compress(record(3))[:-8] + gzip.compress(record(4)))
    got = W.read_warc(spark, tmp_out + "/in").collect()
    assert sorted(r.page_id for r in got if r.gap_reason is None) == [1, 2, 4]
    gaps = [r for r in got if r.gap_reason]
    assert len(gaps) == 2 and {r.length for r in gaps if r.path.endswith("a.warc")} == {3}


def test_lost_response_leaves_a_revisit_without_bytes(spark, tmp_out):
    import os

    os.makedirs(tmp_out + "/in")
    again = record(2, b"", b"revisit", b"WARC-Refers-To: <urn:page:1>\r\nWARC-Payload-Digest: sha1:ABC\r\n")
    with open(tmp_out + "/in/a.warc", "wb") as f:
        f.write(again)
    assert [tuple(r) for r in W.captures(W.read_warc(spark, tmp_out + "/in")).collect()] == [(2, None, "ABC", "revisit", 1)]


def test_empty_table(spark, tmp_out):
    path = W.write_warc(spark.createDataFrame([], PAGES), tmp_out + "/warc")
    assert W.captures(W.read_warc(spark, path)).collect() == []


def test_header_of_any_length(spark, tmp_out):
    url = "data:text/html," + "q=1&" * 50_000
    pages = [(1, url, "same", "d", "r", 1), (2, "u", "same", "d", "r", 1), (3, url + "3", "other", "d", "r", 1)]
    got = W.read_warc(spark, W.write_warc(spark.createDataFrame(pages, PAGES), tmp_out + "/warc"))
    assert got.where("gap_reason is not null").count() == 0
    assert {r.page_id: r.uri for r in got.collect()} == {1: url, 2: "u", 3: url + "3"}
    assert sorted(map(tuple, W.captures(got).collect()), key=str) == brute([(1, "same"), (2, "same"), (3, "other")])


def test_files_are_bounded_in_bytes(spark, tmp_out, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(W, "FILE_BYTES", 64 << 10)
    monkeypatch.setattr(W, "MAX_RECORDS", 32)
    monkeypatch.setattr(W, "CLASS_FACTOR", 4)
    assert W.class_limits() == [(2 << 10, 32), (8 << 10, 8), (32 << 10, 2)]
    rnd = random.Random(2)
    rows = [(i, "u" * (9000 if i % 50 == 1 else 5), chr(97 + i % 26) * rnd.choice([0, 3, 900, 6000, 20_000])) for i in range(200)]
    rows += [(1000, "u", "x" * 300_000), (1001, None, None), (1002, "v", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", "r", 1) for r in rows], PAGES).coalesce(1)
    path = W.write_warc(pages, tmp_out + "/warc")
    sizes = sorted(os.path.getsize(f) for f in glob.glob(path + "/part-*"))
    assert sizes[-1] > 300_000 and sizes[-2] <= 64 << 10 and len(sizes) > 10
    got = W.read_warc(spark, path)
    assert got.where("gap_reason is not null").count() == 0
    assert sorted(map(tuple, W.captures(got).collect()), key=str) == brute([(r[0], r[2]) for r in rows])


def test_unended_headers_are_passed_over():
    far = b"X: " + b"y" * 200_000
    assert read(record(0) + b"WARC/1.1\r\n" + far + record(1) + record(2))[0] == [0, 1, 2]
    assert read(record(0) + b"WARC/1.1\r\n" + far + b"\r\n" + record(1))[0] == [0, 1]
    assert read(b"WARC/1.1\r\nA: b\n\r\n" + record(1) + b"WARC/1." * 2000 + b"WARC/1.1\r\n" + far)[0] == [1]


def test_one_spoilt_record_in_a_member_of_many():
    parts = [record(i, random.Random(i).randbytes(400)) for i in range(6)]
    spoilt = parts[2][:-20] + b"#" + parts[2][-19:]  # wrong digest
    ahead, member = gzip.compress(record(8)), gzip.compress(b"".join([*parts[:2], spoilt, *parts[3:]]))
    ids, gaps = read(ahead + member + record(9))
    assert ids == [8, 0, 1, 3, 4, 5, 9]
    assert gaps == [(len(ahead) + len(parts[0]) + len(parts[1]), len(spoilt))]


def test_records_before_the_damage_of_a_member_return():
    parts = [record(i, random.Random(i).randbytes(40_000)) for i in range(6)]
    whole, later = gzip.compress(b"".join(parts)), gzip.compress(record(9))
    cut = whole[: len(whole) * 2 // 3]
    ids, gaps = read(cut + later)
    assert ids == [0, 1, 2, 9] or ids == [0, 1, 2, 3, 9]
    assert gaps == [(0, len(cut))]
    assert read(cut)[0] == ids[:-1]
    crc = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert read(crc + later) == ([0, 1, 2, 3, 4, 9], [(0, len(crc))])
    stored = gzip.compress(record(0) + record(1), 0)  # its bytes stand in the file as they are
    assert read(stored[:-8] + bytes([stored[-8] ^ 1]) + stored[-7:] + later)[0] == [0, 1, 9]


def test_a_bad_member_does_not_vouch_for_records_without_digest():
    bare = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(bare + record(2) + record(3))
    assert read(whole)[0] == [1, 2, 3]
    assert read(whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:])[0] == [2]
