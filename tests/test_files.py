"""Readers with a quarantine, and one report per scan."""

from __future__ import annotations

import csv
import json

import pytest

from webposture import schemas
from webposture.operators import report
from webposture.operators.report import REPORT_ORDER, ranked_findings
from webposture.sources import sinks, tables

LINES = [
    '{"origin": "https://a.com", "status": 200, "content": "User-agent: *\\nDisallow: /x"}',
    '{"origin": "https://b.com", "status": 404, "content": "gone", "other": [1, 2]}',
    '{"origin": "https://c.com", "status": "many"}',
    '{"origin": "https://d.com", "sta',
    'no json at all',
    '{"status": 200}',
    '{"origin": null, "status": 200}',
    '',
]


def test_broken_lines_are_counted(spark, tmp_path):
    (tmp_path / "robots.json").write_text("\n".join(LINES))
    found = tables.read_checked(spark, str(tmp_path), tables.ROBOTS, "json")
    assert sorted(tuple(r) for r in found.rows.collect()) == [
        ("https://a.com", 200, "User-agent: *\nDisallow: /x"), ("https://b.com", 404, "gone")]
    assert {tuple(r) for r in found.counts().collect()} == {("unreadable", 3), ("missing origin", 2)}
    records = {r.reason: [] for r in found.quarantine.collect()}
    for r in found.quarantine.collect():
        records[r.reason].append(r.record)
    assert sorted(records["unreadable"]) == sorted(LINES[2:5])
    assert [json.loads(x) for x in records["missing origin"]] == [{"status": 200}] * 2
    # Whatever columns are asked for, the same rows are sound.
    assert found.rows.select("origin").count() == 2 and found.quarantine.count() == 5
    assert [r.content for r in tables.read_robots(spark, str(tmp_path), "json").orderBy("origin").collect()] == ["User-agent: *\nDisallow: /x", None]


def test_answers_that_are_arrays(spark, tmp_path):
    answers = ['[{"domain": "a.com", "name_value": "x.a.com"}, {"domain": "a.com"}, {"domain": "a.com", "name_value": "y.a.com", "id": 7}]', "[]", '[{"domain": "a.com", ']
    (tmp_path / "ct.json").write_text("\n".join(answers))
    found = tables.read_checked(spark, str(tmp_path), tables.CT, "json")
    assert sorted(r.name_value for r in found.rows.collect()) == ["x.a.com", "y.a.com"]
    assert {tuple(r) for r in found.counts().collect()} == {("missing name_value", 1), ("unreadable", 1)}


def test_all_readers(spark, tmp_path):
    """Every reader returns what was written, and no row that lacks a key."""
    cases = {
        "targets": (tables.read_targets, tables.TARGETS, ("s", "https://a.com")), "dns": (tables.read_dns, tables.DNS, ("a", "a", "TXT", 0, 0, "v")),
        "tls": (tables.read_tls, tables.TLS, ("a", True, True, "TLSv1.3", 1, 0, True, None)), "ct": (tables.read_ct, tables.CT, ("a", "x.a")),
        "events": (tables.read_scan_events, tables.SCAN_EVENTS, ("s", "running", None, 1)),
    }
    for name, (read, kind, row) in cases.items():
        broken = tuple(None if n == kind.required[0] else v for n, v in zip(kind.schema.names, row))
        frame = spark.createDataFrame([row, broken], kind.schema)
        for fmt in ("parquet", "json"):
            path = str(tmp_path / name / fmt)
            frame.write.format(fmt).save(path)
            assert [tuple(r) for r in read(spark, path, fmt).collect()] == [row]
            assert [tuple(r) for r in tables.read_checked(spark, path, kind, fmt).counts().collect()] == [(f"missing {kind.required[0]}", 1)]


def test_responses_keep_headers_and_need_no_body(spark, tmp_path):
    rows = [("s", "https://a.com/", 200, [("A", "1"), ("a", "2")], "text", 4, None, None), (None, "https://b.com/", 200, [], "x" * 10, None, None, None)]
    spark.createDataFrame(rows, schemas.RESPONSES).write.parquet(str(tmp_path / "in"))
    found = tables.read_responses(spark, str(tmp_path / "in"))
    assert [[tuple(h) for h in r.headers] for r in found.collect()] == [[("A", "1"), ("a", "2")]]
    narrow = found.select("url")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in narrow[narrow.index("ReadSchema"):]


def findings(spark, large=500, small=40):
    rows = [("big", f"https://b.com/{k}", ("critical", "low", "info")[k % 3], "tls_issue", f't "{k}",', "d\nd", "" if k % 2 else "e\\", None if k % 5 else k) for k in range(large)]
    rows += [(f"s{k}", "https://s.com/", "high", "tls_issue", "t", "d", "e", 1) for k in range(small)]
    return spark.createDataFrame(rows, schemas.FINDINGS)


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_one_report_per_scan(spark, tmp_path, fmt):
    found, path = findings(spark), str(tmp_path)
    info = found.select("scan_id").distinct().withColumn("target", found.scan_id)
    sinks.write_scan_reports(info, report.summary(found), found, path, fmt, file_rows=100)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, sinks.read_scan_reports(spark, path, fmt).collect()), key=key) == sorted(map(tuple, found.collect()), key=key)
    folders = {p.name: sorted(p.glob("part*")) for p in (tmp_path / "findings").iterdir() if p.is_dir()}
    assert len(folders) == 41 and len(folders["scan_id=big"]) >= 5
    assert all(len(files) == 1 for name, files in folders.items() if name != "scan_id=big")
    # Many small scans come from one task: the number of the task is in the name.
    assert len({f.name.split("-")[1] for name, files in folders.items() if name != "scan_id=big" for f in files}) <= 4
    lines = [[json.loads(x) for x in f.open()] if fmt == "json" else list(csv.DictReader(f.open(newline=""))) for f in folders["scan_id=big"]]
    assert all(len(x) <= 100 for x in lines)
    titles = [r["title"] for x in lines for r in x]
    order = ranked_findings(found).filter("scan_id = 'big'").orderBy(*REPORT_ORDER)
    assert titles == [r.title for r in order.collect()]
    heads = {r.scan_id: r.total_findings for r in spark.read.json(f"{path}/heads").collect()}
    assert heads["big"] == 500 and len(heads) == 41


def test_many_reports_share_folders(spark, tmp_path):
    found, path = findings(spark), str(tmp_path)
    info = found.select("scan_id").distinct().withColumn("target", found.scan_id)
    sinks.write_scan_reports(info, report.summary(found), found, path, file_rows=100, max_folders=40, folder_scans=10)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, sinks.read_scan_reports(spark, path).collect()), key=key) == sorted(map(tuple, found.collect()), key=key)
    folders = {p.name: sorted(p.glob("part*")) for p in (tmp_path / "findings").iterdir() if p.is_dir()}
    assert set(folders) <= {f"scan_group={k}" for k in range(5)}
    rows = {name: [json.loads(x) for f in files for x in f.open()] for name, files in folders.items()}
    assert all(sum(1 for _ in f.open()) <= 100 for files in folders.values() for f in files)
    # A report is one run of rows, in report order, and its head lies in the folder of the same name.
    heads = {r.scan_id: f"scan_group={r.scan_group}" for r in spark.read.json(f"{path}/heads").collect()}
    assert len(heads) == 41
    for name, lines in rows.items():
        runs = [r["scan_id"] for i, r in enumerate(lines) if i == 0 or lines[i - 1]["scan_id"] != r["scan_id"]]
        assert len(runs) == len(set(runs)) and all(heads[s] == name for s in runs)
    order = ranked_findings(found).filter("scan_id = 'big'").orderBy(*REPORT_ORDER)
    assert [r["title"] for r in rows[heads["big"]] if r["scan_id"] == "big"] == [r.title for r in order.collect()]


def test_a_folder_each_is_only_for_few_reports(spark, tmp_path):
    found = findings(spark, large=10, small=1_001)
    info = found.select("scan_id").distinct().withColumn("target", found.scan_id)
    sinks.write_scan_reports(info, report.summary(found), found, str(tmp_path))
    for part in ("findings", "heads"):
        assert len([p for p in (tmp_path / part).iterdir() if p.is_dir()]) == 1
    assert sinks.read_scan_reports(spark, str(tmp_path)).count() == 1_011
