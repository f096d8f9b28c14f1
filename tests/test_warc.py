from __future__ import annotations

import bz2
import gzip
import io
import io

import pytest

from scanmill.operators.documents import corpus_health, count_records
from scanmill.operators.statistics import compute_term_statistics
from scanmill.sources.tables import read_docid_list
from scanmill.sources import warc
from scanmill.sources.warc import (
    CUT_OFF,
    NO_LENGTH,
    OVERSIZED,
    read_warc,
    records_of,
    split_path,
    warc_docid,
    warc_documents,
)


def record(version, body, *headers, length=None):
    length = len(body) if length is None else length
    head = [f"WARC/{version}", *headers, f"Content-Length: {length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def page(text, docid, version="1.0", **options):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n" + text.encode()
    return record(version, body, "WARC-Type: response", f"WARC-TREC-ID: {docid}", **options)


INFO = record("1.0", b"software: x\r\n", "WARC-Type: warcinfo", "broken line")


@pytest.fixture
def folder(tmp_path):
    def write(name, *records, codec=gzip):
        data = b"".join(codec.compress(r) for r in records) if codec else b"".join(records)
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / "*")

    return write


def collected(df):
    return [r.asDict() for r in df.orderBy("path", "record_no").collect()]


@pytest.mark.parametrize("name, codec", [("a.warc.gz", gzip), ("a.warc.bz2", bz2), ("a.warc", None)])
def test_codecs_and_members(spark, folder, name, codec):
    path = folder(name, INFO, page("<p>one</p>", "id-1"), page("<p>WARC/1.0</p>\nWARC/1.0\n", "id-2"), codec=codec)
    rows = collected(read_warc(spark, path))
    assert [r["record_no"] for r in rows] == [1, 2, 3]
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response", "response"]
    assert rows[0]["headers"]["broken line"] == ""
    assert rows[2]["headers"]["WARC-TREC-ID"] == "id-2"
    assert rows[1]["content"].endswith(b"<p>one</p>")
    assert all(r["path"].endswith(name) for r in rows)
    docs = collected(warc_documents(read_warc(spark, path)))
    assert [(d["docid"], d["content"]) for d in docs[1:]] == [
        ("id-1", "<p>one</p>"), ("id-2", "<p>WARC/1.0</p>\nWARC/1.0\n"),
    ]
    assert docs[0]["docid"] is None


def test_headers_after_the_length(spark, folder):
    late = b"WARC/0.18\nContent-Length: 4\nWARC-TREC-ID: x\nWARC-Date: 2009\n\nbody\n\n"
    rows = collected(read_warc(spark, folder("b.warc.gz", late, page("t", "y", "0.18")), "0.18"))
    assert rows[0]["content"] == b"body"
    assert rows[0]["headers"]["WARC-TREC-ID"] == "x" and rows[0]["warc_date"] == "2009"
    assert rows[1]["content_length"] == len(rows[1]["content"])


def test_other_version_is_not_a_record(spark, folder):
    path = folder("c.warc.gz", page("t", "a", "0.18"), page("t", "b", "1.0"))
    assert [r["headers"]["WARC-TREC-ID"] for r in collected(read_warc(spark, path, "0.18"))] == ["a"]
    with pytest.raises(ValueError):
        read_warc(spark, path, "1.1")


@pytest.mark.parametrize("length", ["-5", "many", "1.5", ""])
def test_bad_length_costs_one_record_its_content(spark, folder, length):
    path = folder("d.warc.gz", page("t", "a"), page("<p>x", "bad", length=length), page("t", "b"))
    rows = collected(read_warc(spark, path))
    assert [(r["headers"]["WARC-TREC-ID"], r["damage"]) for r in rows] == [
        ("a", None), ("bad", NO_LENGTH), ("b", None),
    ]
    docs = warc_documents(read_warc(spark, path))
    assert corpus_health(docs).first().asDict() == {"total": 3, "pages": 3, "errors": 1, "too_long": 0}


def test_cut_off_file_says_so():
    data = page("one", "a") + page("two", "b")
    for keep in (True, False):
        found = list(records_of(io.BytesIO(data[:-10]), "1.0", keep))
        assert [(h["WARC-TREC-ID"], d) for h, _, _, d in found] == [("a", None), ("b", CUT_OFF)]


def test_cut_off_compressed_file(spark, tmp_path):
    first, second = gzip.compress(page("one", "a")), gzip.compress(page("two" * 500, "b"))
    (tmp_path / "cut.warc.gz").write_bytes(first + second[:-30])
    rows = collected(read_warc(spark, str(tmp_path)))
    assert [(r["headers"].get("WARC-TREC-ID"), r["damage"]) for r in rows] == [("a", None), ("b", CUT_OFF)]
    (tmp_path / "cut.warc.gz").write_bytes(first + second[:12])
    rows = collected(read_warc(spark, str(tmp_path)))
    assert [(r["headers"].get("WARC-TREC-ID"), r["damage"]) for r in rows] == [("a", None), (None, CUT_OFF)]
    (tmp_path / "cut.warc.gz").write_bytes(b"not gzip at all")
    with pytest.raises(Exception, match="inflate|gzip|header"):
        read_warc(spark, str(tmp_path)).collect()


def test_large_records_and_wrong_lengths(spark, folder):
    path = folder(
        "big.warc.gz",
        page("x" * 20_000_000, "a"),
        page("<p>t", "huge", length=1 << 40),
        page("y" * 9_000_000, "b"),
        page("t", "cut", length=1 << 30),
    )
    for content in (True, False):
        rows = read_warc(spark, path, with_content=content)
        rows = collected(rows.select("path", "record_no", "headers", "content_length", "damage"))
        assert [(r["headers"]["WARC-TREC-ID"], r["damage"]) for r in rows] == [
            ("a", None), ("huge", OVERSIZED), ("b", None), ("cut", CUT_OFF),
        ]
        assert rows[0]["content_length"] > 20_000_000 and rows[1]["content_length"] == 1 << 40


@pytest.mark.parametrize("name", ["a b.warc.gz", "a#b.warc.gz", "a%20b.warc.gz", "a[1].warc", "é.warc.bz2"])
def test_names_that_need_care(spark, tmp_path, name):
    codec = {"gz": gzip.compress, "bz2": bz2.compress}.get(name.rsplit(".", 1)[1], bytes)
    (tmp_path / name).write_bytes(codec(page("t", "a")))
    for whole in (False, True):
        rows = collected(read_warc(spark, str(tmp_path), whole_files=whole))
        assert [r["headers"]["WARC-TREC-ID"] for r in rows] == ["a"]


def test_paths_are_split_as_spark_lists_them():
    assert split_path("file:/a b/c#d%20e") == ("file", "", "/a b/c#d%20e")
    assert split_path("file:///x") == ("file", "", "/x")
    assert split_path("/x/y:z") == ("file", "", "/x/y:z")
    assert split_path("s3a://bucket/k/x.gz") == ("s3a", "bucket", "/k/x.gz")
    assert split_path("hdfs://h:9000/k") == ("hdfs", "h:9000", "/k")
    assert split_path("wasbs://c@acc.blob.host/k") == ("wasbs", "c@acc.blob.host", "/k")


def test_a_store_that_only_spark_opens(spark, folder, tmp_path):
    folder("v.warc.gz", page("t", "a"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tests.link./in", tmp_path.as_uri())
    rows = collected(read_warc(spark, "viewfs://tests/in", whole_files=True))
    assert [r["headers"]["WARC-TREC-ID"] for r in rows] == ["a"]


def test_counting_and_statistics(spark, folder):
    folder("e1.warc.gz", INFO, page("<p>apple banana</p>", "1"), page("<p>apple <script>x</script>", "2"))
    path = folder("e2.warc.gz", INFO, page("<td>apple</td><td>pie</td>", "3"))
    headers = read_warc(spark, path, with_content=False)
    assert headers.filter("content IS NOT NULL").count() == 0
    assert count_records(headers.withColumn("docid", warc_docid())).first().asDict() == {"total": 5, "pages": 3}
    stats = compute_term_statistics(warc_documents(read_warc(spark, path)), "standard", 1)
    assert {r.term: (r.df, r.cf) for r in stats.collect()} == {
        "apple": (3, 3), "banana": (1, 1), "pie": (1, 1),
    }


def test_docid_list(spark, tmp_path):
    path = tmp_path / "ids.bz2"
    path.write_bytes(bz2.compress(b"id-1,http://a,x\nid-2\nid-3,b\n"))
    assert [r.docid for r in read_docid_list(spark, str(path)).collect()] == ["id-1", "id-2", "id-3"]
    assert read_docid_list(spark, str(path), max_rows=2).count() == 2


@pytest.mark.parametrize("content", [True, False])
def test_large_uncompressed_files_are_read_in_runs(spark, tmp_path, monkeypatch, content):
    """The same records, numbers and damage as in one pass, in many tasks; bodies that look like records stay bodies."""
    records = [INFO, *(page(f"{'x' * (i * 37 % 900)}\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nno record", f"id{i}") for i in range(80))]
    records[20] = page("wrong", "far", length=1 << 40)
    records[40] = b"garbage between\r\n" + records[40]
    data = b"".join(records) + page("cut", "end", length=10_000)
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(data))
    shown = ["record_no", "headers", "content_length", "content", "damage"]

    def rows(name):
        found = read_warc(spark, str(tmp_path / name), with_content=content)
        return found, sorted(([r[c] for c in shown] for r in found.collect()), key=lambda r: r[0])

    _, expected = rows("packed.warc.gz")
    monkeypatch.setattr(warc, "RUN_BYTES", 4000)
    found, got = rows("plain.warc")
    assert got == expected and got[-1][-1] == CUT_OFF and len(got) > 80
    assert found.rdd.getNumPartitions() > 8
    # Both kinds of files in one scan.
    assert read_warc(spark, str(tmp_path), with_content=content).count() == 2 * len(got)


def test_runs_cover_all_records():
    for size in (1, 500, 5000, 1 << 30):
        data = b"".join([b"noise\n", *(page("t" * (i * 53 % 400), f"id{i}") for i in range(30)), b"\n\nrest"])
        runs = list(warc.runs_of(io.BufferedReader(io.BytesIO(data)), "1.0", len(data), size))
        assert sum(n for _, _, n in runs) == 30 and [f for _, f, _ in runs] == [1 + sum(n for *_, n in runs[:i]) for i in range(len(runs))]
        assert all(data[p:].startswith(b"WARC/1.0") for p, _, _ in runs) and runs[0][0] == 6
    assert list(warc.runs_of(io.BufferedReader(io.BytesIO(b"none")), "1.0", 4, 10)) == []
