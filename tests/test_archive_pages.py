"""The pages of an archive, with columns of their records."""

from __future__ import annotations

from scanmill.sources.warc import read_warc, warc_documents
from suite.archives import _responses


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_an_archive_need_no_join(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n<p>x</p>"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-TREC-ID: %s\r\nContent-Length: %d\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(head % (d, len(body)) + body + b"\r\n" for d in (b"x", b"y", b"y")))
    records = read_warc(spark, str(tmp_path / "a.warc"))
    pages = _responses(records, "1.0")
    assert "Join" not in _plan(pages)
    assert sorted((r.docid, r.warc_type, r.content_length, r.content) for r in pages.collect()) == [
        (d, "response", len(body), "<p>x</p>") for d in ("x", "y", "y")
    ]
    kept = warc_documents(records, "1.0", ("warc_date",))
    assert kept.columns == ["docid", "content", "path", "record_no", "warc_date"]
