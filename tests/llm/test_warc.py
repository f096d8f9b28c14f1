from __future__ import annotations

import gzip

from scanmill.llm import warc_salvage
from scanmill.llm.warc_salvage import (
    digest_of,
    member,
    quarantined,
    record_bytes,
    salvage,
    salvage_archives,
    write_archives,
)
from scanmill.runtime import scratch_path

RECORDS = [
    record_bytes(i, f"http://h/{i}", f"payload {i} WARC/1.0\r\n\r\n".encode() * 5, False, None) for i in range(6)
]


def ids(data):
    return [int(f.headers["x-page-id"]) for f in salvage(data) if f.reason is None]


def gaps(data):
    return [(f.start, f.end) for f in salvage(data) if f.reason is not None]


def test_whole_files():
    members = [member(r) for r in RECORDS]
    for data in (b"".join(members), b"".join(RECORDS), gzip.compress(b"".join(RECORDS))):
        assert ids(data) == list(range(6)) and gaps(data) == []
    assert all(m[-1] == 0 for m in members) and ids(b"") == gaps(b"") == []


def test_broken_members_are_passed_over():
    members = [member(r) for r in RECORDS]
    ends = [sum(map(len, members[: i + 1])) for i in range(6)]
    broken = bytearray(b"".join(members))
    broken[ends[1] + 60] ^= 0xFF  # inside member 2
    assert ids(bytes(broken)) == [0, 1, 3, 4, 5] and gaps(bytes(broken)) == [(ends[1], ends[2])]
    broken[ends[3] : ends[3] + 3] = b"xyz"  # the magic number of member 4
    assert ids(bytes(broken)) == [0, 1, 3, 5] and gaps(bytes(broken)) == [(ends[1], ends[2]), (ends[3], ends[4])]
    cut = b"".join(members)[:-30]
    assert ids(cut) == [0, 1, 2, 3, 4] and gaps(cut) == [(ends[4], len(cut))]
    assert ids(b"garbage" + members[0] + b"junk" + members[1]) == [0, 1]


def test_broken_plain_records_are_passed_over():
    ends = [sum(map(len, RECORDS[: i + 1])) for i in range(6)]
    data = b"".join(RECORDS)
    wrong = data.replace(b"X-Page-ID: 2\r\n", b"X-Page-ID 2 \r\n")
    assert ids(wrong) == [0, 1, 3, 4, 5] and gaps(wrong) == [(ends[1], ends[2])]
    other = bytearray(data)
    other[ends[2] - 10] ^= 1  # a byte of the payload of record 2: its digest differs
    assert ids(bytes(other)) == [0, 1, 3, 4, 5]
    at = data.index(b"Content-Length: ", ends[0])
    longer = data[:at] + b"Content-Length: 9" + data[at + 16 :]
    assert 1 not in ids(longer) and ids(longer)[-4:] == [2, 3, 4, 5]


def test_a_single_member_keeps_what_comes_before_the_damage():
    data = bytearray(gzip.compress(b"".join(RECORDS) + bytes(range(256)) * 300 + RECORDS[0], compresslevel=0))
    data[-40] ^= 0xFF
    found = list(salvage(bytes(data)))
    assert [f.headers["x-page-id"] for f in found if f.reason is None][:6] == list("012345")
    assert found[-1].reason is not None


def test_round_trip(spark):
    rows = [
        (3, "http://a/\r\nX: y", "same"),
        (1, None, "same"),
        (2, "u", None),
        (4, "u", ""),
        (5, "u", "é\x00\x1f\x8b" * 10),
        (None, "u", "same"),
        (6, "u", "long" * 300_000),
        (3, "u", "same"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("url", "URL")
    for least, kinds in ((0, "revisit response response revisit response revisit response revisit"), (5, "response " * 8)):
        path = scratch_path(spark, "warc-test")
        write_archives(pages, path, min_bytes=least)
        got = salvage_archives(spark, path, with_payload=True)
        assert quarantined(got).collect() == []
        found = sorted(
            ((r.headers.get("x-page-id"), r.warc_type, r.payload_bytes, r.payload_digest, r.headers.get("x-refers-to-page-id")) for r in got.collect()),
            key=repr,
        )
        first = {"same": "1", None: "2", "": "2"}
        expected = []
        for (page, _, html), kind in zip(rows, kinds.split()):
            payload = (html or "").encode()
            expected.append(
                (None if page is None else str(page), kind, len(payload), digest_of(payload), first[html] if kind == "revisit" else None)
            )
        assert found == sorted(expected, key=repr)


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert salvage_archives(spark, path).collect() == []


def test_plain_records_after_a_broken_member():
    first = member(RECORDS[0])
    for cut in range(30, len(first) - 20, 7):
        data = first[:cut] + b"\r\n" + b"".join(RECORDS[1:4]) + member(RECORDS[4])
        assert ids(data) == [1, 2, 3, 4] and gaps(data) == [(0, cut + 2)]
    stored = bytearray(gzip.compress(b"".join(RECORDS[:3]), compresslevel=0))
    stored[-6] ^= 0xFF  # the checksum: what the member stores is not read twice
    assert ids(bytes(stored)) == [0, 1, 2]
    assert ids(bytes(stored) + b"\n" + b"".join(RECORDS[1:4])) == [0, 1, 2, 1, 2, 3]


def test_an_archive_inside_a_record_stays_inside():
    for inner in (member(RECORDS[1]), RECORDS[1] + member(RECORDS[2]), gzip.compress(b"".join(RECORDS[:3]))):
        outer = record_bytes(7, "u", inner, False, None)
        for data in (outer, outer + RECORDS[3], member(outer), RECORDS[0] + outer + member(RECORDS[4])):
            assert gaps(data) == [] and set(ids(data)) - {0, 3, 4} == {7}
        found = next(f for f in salvage(outer))
        assert found.block.endswith(inner)
    # Once the outer record fails, what can be read inside it is read.
    outer = record_bytes(7, "u", member(RECORDS[1]), False, None).replace(b"X-Page-ID: 7", b"X-Page-ID 7!")
    assert ids(outer + RECORDS[3]) == [1, 3]


def test_long_urls_and_many_failures(spark):
    path = scratch_path(spark, "warc-test")
    rows = [(1, "http://h/" + "u" * (2 << 20), "x"), (2, "http://h/" + "\n" * (1 << 20), "y")]
    write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = salvage_archives(spark, path).collect()
    assert sorted(r.headers["x-page-id"] for r in got) == ["1", "2"] and not any(r.gap for r in got)
    bad = RECORDS[0].replace(b"WARC-Type", b"WARC Type:").replace(b": ", b" ")
    data = bad * 3000 + RECORDS[1]
    assert ids(data) == [1] and gaps(data) == [(0, len(bad) * 3000)]


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    import random

    monkeypatch.setattr(warc_salvage, "_ROW_BYTES", 4096)
    rng = random.Random(1)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    rows = [(i, "u", noise(rng.choice([100, 2000, 60_000]) if i % 9 else 300_000)) for i in range(120)]
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    write_archives(pages, path)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) > 20 and max(f.length for f in files) < 300_000 + 17 * 4096
    got = salvage_archives(spark, path).collect()
    assert sorted(int(r.headers["x-page-id"]) for r in got) == list(range(120)) and not any(r.gap for r in got)
