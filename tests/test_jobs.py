"""The whole chain on the command line: archive to ranked run."""

from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from scanmill.__main__ import parser, run
from scanmill.plans import jobs
from scanmill.runtime import scratch_cleared, shared_dir, written
from tests.test_warc import INFO, page

PAGES = {
    "cw-1": "<title>Apple</title><p>apple pies and apple trees",
    "cw-2": "<p>banana trees",
    "cw-3": "<p>apples",
    "cw-4": "<p>nothing here",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    (base / "w").mkdir()
    for name, ids in (("a", ["cw-1", "cw-2"]), ("b", ["cw-3", "cw-4"])):
        records = [INFO, *(page(PAGES[i], i) for i in ids)]
        (base / "w" / f"{name}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (base / "queries").write_text("1:apple tree\nbad line\n2:banana\n")

    def job(text):
        run(spark, parser().parse_args(text.format(b=base).split()))

    job("term-statistics --input {b}/w/a*.gz --output {b}/s/disk1 --df-min 1")
    job("term-statistics --input {b}/w/b*.gz --output {b}/s/disk2 --df-min 1")
    job("merge-statistics --input {b}/s/disk* --output {b}/s/all --df-min 1")
    job("dictionary --input {b}/s/all --output {b}/dict --count 5")
    job("doc-vectors --input {b}/w/*.gz --output {b}/flat --dictionary {b}/dict --partitions 2")
    job("doc-vectors --input {b}/w/*.gz --output {b}/unique --dictionary {b}/dict --unique")
    return base, job


@pytest.fixture
def lines(spark, base):
    def read(name):
        return sorted(r.value for r in spark.read.text(f"{base[0]}/{name}").collect())

    return read


def test_vectors_and_dumps(base, lines):
    folder, job = base
    job("decode-vectors --input {b}/flat --output {b}/decoded --dictionary {b}/dict")
    assert lines("decoded") == [
        "cw-1\tappl|appl|pi|appl|tree", "cw-2\tbanana|tree", "cw-3\tappl", "cw-4\tnoth",
    ]
    job("plain-text --input {b}/w/*.gz --output {b}/plain")
    assert lines("plain")[0] == "cw-1\tapple|apple|pies|apple|trees"
    job("term-ids --input {b}/w/*.gz --output {b}/ids --dictionary {b}/dict --preprocessing porter --partitions 1")
    assert [line.split("\t")[0] for line in lines("ids")] == list(PAGES)


def test_runs(base, lines):
    folder, job = base
    for name, vectors in (("flat", "flat"), ("unique", "unique --unique")):
        job(
            "bm25 --input {b}/" + vectors + " --output {b}/run-" + name
            + " --dictionary {b}/dict --queries {b}/queries --topk 5 --all-documents"
        )
        job(
            "lm --input {b}/" + vectors + " --output {b}/lm-" + name
            + " --dictionary {b}/dict --queries {b}/queries --topk 5"
        )
    assert lines("run-flat") == lines("run-unique") and len(lines("run-flat")) == 8
    assert lines("lm-flat") == lines("lm-unique")
    assert lines("lm-flat")[-1].startswith("2 Q0 cw-2 1 ") and lines("lm-flat")[-1].endswith(" lmretrieval")


def test_scratch_tables_go_when_a_job_ends(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with pytest.raises(RuntimeError), scratch_cleared(spark):
        written(spark.range(3), "left")
        assert set(folder.iterdir()) - before
        raise RuntimeError
    assert set(folder.iterdir()) == before


def test_counters(base, capsys):
    folder, job = base
    capsys.readouterr()
    job("term-statistics --input {b}/w/*.gz --output {b}/s/again --df-min 1")
    counts = dict(line.split("\t") for line in capsys.readouterr().out.splitlines() if "\t" in line)
    assert counts == {"total": "6", "pages": "4", "errors": "0", "too_long": "0"}
    job("doc-vectors --input {b}/w/*.gz --output {b}/again --dictionary {b}/dict")
    counts = dict(line.split("\t") for line in capsys.readouterr().out.splitlines() if "\t" in line)
    assert counts == {"total": "6", "pages": "4", "errors": "0", "too_long": "0", "encoded_terms": "9"}


def test_lookups_and_options_are_not_cut(base, lines, capsys):
    folder, job = base
    capsys.readouterr()
    long = "x" * 40
    job("lookup --dictionary {b}/dict " + " ".join(f"--term {long}{i}" for i in range(25)))
    shown = capsys.readouterr().out.replace("|", " ").split()
    assert all(f"{long}{i}" in shown for i in range(25))
    job(
        "bm25 --input {b}/flat --output {b}/run-options --dictionary {b}/dict --queries {b}/queries --topk 5 "
        "--k1 1.2 --b 0.5 --average-length measured --tie docid_desc --tag mine"
    )
    assert lines("run-options") and all(line.endswith(" mine") for line in lines("run-options"))
    job(
        "lm --input {b}/flat --output {b}/lm-options --dictionary {b}/dict --queries {b}/queries --topk 5 "
        "--background cf --tag other"
    )
    assert all(line.endswith(" other") for line in lines("lm-options"))


def test_reports(base, capsys, tmp_path):
    folder, job = base
    capsys.readouterr()
    job("count-records --input {b}/w/*.gz")
    assert "|    6|    4|" in capsys.readouterr().out
    job("lookup --dictionary {b}/dict --term appl --term zzz --term-id 1")
    assert "appl" in capsys.readouterr().out
    (folder / "ids").mkdir(exist_ok=True)
    (folder / "list.txt").write_text("cw-1,x\ncw-2,y\n")
    job("docno-mapping --input {b}/list.txt --output {b}/map")
    job("docno-lookup --index {b}/map --docid cw-2 --docno 0")
    out = capsys.readouterr().out
    assert "|cw-2 |1    |" in out and "|0    |cw-1 |" in out


def test_segments_are_counted_one_by_one(spark, base):
    """Totals from one segment at a time equal those of all at once; counting one again changes nothing."""
    folder, job = base
    common = "replace-segment --segments {b}/seg --segment "
    job(common + "a --input {b}/w/a*.gz --merged {b}/none --output {b}/m1")
    job(common + "b --input {b}/w/b*.gz --merged {b}/m1 --output {b}/m2")
    job(common + "a --input {b}/w/a*.gz --merged {b}/m2 --output {b}/m3")
    whole = sorted(map(tuple, spark.read.parquet(f"{folder}/s/all").collect()))
    for name in ("m2", "m3"):
        assert sorted(map(tuple, spark.read.parquet(f"{folder}/{name}").collect())) == whole


def test_rejected_queries_are_written_beside_the_run(spark, base, lines):
    folder, job = base
    job("bm25 --input {b}/flat --output {b}/run-r --dictionary {b}/dict --queries {b}/queries --topk 2")
    assert lines("run-r-rejects") == ["no colon\tbad line"]


def test_many_runs_over_vectors_kept_in_memory(spark, base, lines):
    folder, job = base
    (folder / "more").write_text("7:banana\n")
    runs = {f"{folder}/run-1": f"{folder}/queries", f"{folder}/run-2": f"{folder}/more"}
    jobs.bm25_runs(spark, f"{folder}/flat", runs, f"{folder}/dict", 2)
    assert [x.split()[:3] for x in lines("run-2")] == [["7", "Q0", "cw-2"]]
    assert lines("run-1") and not Path(f"{folder}/run-2-rejects").exists()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
