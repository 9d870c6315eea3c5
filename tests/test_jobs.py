"""The jobs: against DuckDB on whole tables, over growing input, on awkward rows, and run again after an interruption."""

import datetime
import json
import os
import subprocess
import sys

import pytest
from conftest import ROOT, SF
from test_catalog import plain

from jobs import artifact_ledger, registered, track_resampling
from jobs.common import config_of
from voxlake.tables import exists

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, run string"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def same(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_job_against_duckdb(spark, duck, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got, want = registered.QUERIES[name](spark, SF), duck.sql(registered.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    assert same(got.collect(), got.columns) == sorted((tuple(plain(r[at[c]]) for c in got.columns) for r in want.fetchall()), key=repr)
    assert before == {k: spark.conf.get(k) for k in before}


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    job = lambda to=out, by=mark: artifact_ledger.run(spark, place, to, by, config_of("artifact_ledger"))
    docs.where("doc_id % 3 = 0").coalesce(1).write.parquet(place)
    assert job()["rows"] == docs.where("doc_id % 3 = 0").count()
    assert job() == {"batches": 0, "rows": 0, "runs": 0}
    late = docs.where("doc_id % 3 <> 0 and source <> 'src1'")
    late.coalesce(2).write.mode("append").parquet(place)
    third = job()
    touched = late.select("source").distinct().count()
    assert (third["rows"], third["runs"]) == (late.count(), touched)  # src1 isn't written again
    assert job(f"{tmp_path}/once", f"{tmp_path}/mark-once")["rows"] == docs.count() - docs.where("doc_id % 3 <> 0 and source = 'src1'").count()
    columns = artifact_ledger.read(spark, out).columns
    assert same(artifact_ledger.read(spark, out).collect(), columns) == same(artifact_ledger.read(spark, f"{tmp_path}/once").collect(), columns)


def test_ledger_on_awkward_rows(spark, tmp_path):
    rows = [
        (1, "a\nb", "en", "Run A", 3, "x"), (1, "other", "en", "Run A", 5, "x"), (2, None, None, None, None, None), (None, "", "en", None, 0, None), (None, "", "en", None, 0, None),
        (3, "same", "en", "B", 4, None), (4, "same", "en", "B", 4, None), (5, "x" * 2_000_000, "en", "run a", 7, None), (6, "ok", None, "c", 2, None), (7, "ok", None, "d", None, None),
    ]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/docs")
    for _ in range(2):
        artifact_ledger.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("artifact_ledger"))
    got = artifact_ledger.read(spark, f"{tmp_path}/out").collect()
    assert len(got) == len(rows)
    by = {r["source"]: (r["run"], r["artifacts"], r["contents"], r["conflicts"], r["source_status"]) for r in got}
    assert by == {"Run A": ("run-run-a", 2, 2, 1, "FAIL"), "run a": ("run-run-a", 1, 1, 0, "FAIL"), None: ("run-", 3, 1, 0, "NOT_EVALUABLE"), "B": ("run-b", 2, 1, 0, "WARNING"), "c": ("run-c", 1, 1, 0, "PASS"), "d": ("run-d", 1, 1, 0, "PASS")}
    assert {r["doc_id"]: r["status"] for r in got if r["doc_id"] in (2, 5, 6, 7)} == {2: "missing", 5: "size_mismatch", 6: "ok", 7: "undeclared"}


def test_ledger_catches_up_after_an_interruption(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/docs")
    args = (spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("artifact_ledger"))

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(artifact_ledger, "summaries", stopped)
        with pytest.raises(RuntimeError):
            artifact_ledger.run(*args)
    assert exists(spark, f"{tmp_path}/out/ledger") and not exists(spark, f"{tmp_path}/out/summary")
    took = artifact_ledger.run(*args)
    assert took["rows"] == 0 and took["runs"] > 0
    assert artifact_ledger.read(spark, f"{tmp_path}/out").where("artifacts is null").count() == 0


def test_ledger_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/docs")
    assert artifact_ledger.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("artifact_ledger"))["rows"] == 0
    assert artifact_ledger.read(spark, f"{tmp_path}/out").count() == 0


def test_resampling_on_awkward_rows(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = lambda hours: day + datetime.timedelta(hours=hours)
    rows = [
        (1, at(0), 1, "view", 0.0, None), (2, at(72), 1, "view", 72.0, None), (3, at(30), 1, "error", None, None), (4, at(29.5), 2, "error", 5.0, None), (5, at(29.5), 2, "view", 7.0, None),
        (6, None, 1, "view", 1.0, None), (7, at(1), None, "view", 1.0, None), (8, at(48.2), 2, "view", 9.0, None), (9, at(30.2), 2, "error", 9.0, None),
    ]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")
    seen = []
    for _ in range(2):
        track_resampling.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("track_resampling") | {"least_formal": 0.7})
        seen.append(same(track_resampling.read(spark, f"{tmp_path}/out").collect(), ["day", "track", "place", "value", "formal", "passed"]))
    assert seen[0] == seen[1]
    base = int(at(0).replace(tzinfo=datetime.timezone.utc).timestamp()) // 21600
    got = {(r[1], r[2] - base): (r[3], r[4]) for r in seen[0]}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, k): (6.0 * k, True) for k in range(13)}  # a line across days without points
    assert {k[1]: v[1] for k, v in got.items() if k[0] == 2} == {5: False, 6: True, 7: True, 8: True}
    assert [r[5] for r in seen[0] if r[1] == 2] == [False, False, False, True]  # two of three samples of the first day are formal


def test_resampling_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/events")
    assert track_resampling.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("track_resampling")) == {"events": 0, "samples": 0, "tracks_and_days": 0}


def test_a_track_that_outgrows_its_blocks(spark, tmp_path):
    """One track holds most rows; blocks of an hour give what one block gives."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=7 * i), 1 if i % 5 else 2, "error" if i % 50 == 0 else "view", float(i % 13), None) for i in range(1500)]
    frame = spark.createDataFrame(rows, EVENTS)
    got = [same(track_resampling.samples(frame, config_of("track_resampling") | {"spacing_s": 600, "block_s": b}).collect(), ["day", "track", "place", "value", "formal"]) for b in (3600, 10**9)]
    assert got[0] == got[1] and len(got[0]) > 1700


def test_command_lines(spark, tmp_path):
    """Each in a session of its own, with a configuration file that changes a default."""
    (tmp_path / "config.json").write_text(json.dumps({"warn_copies": False}))
    docs = [(1, "same", "en", "s", 4, None), (2, "same", "en", "s", 4, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/docs")
    line = [sys.executable, "-m", "jobs.artifact_ledger", "--input", f"{tmp_path}/docs", "--output", f"{tmp_path}/out", "--mark", f"{tmp_path}/mark", "--config", str(tmp_path / "config.json")]
    for rows in (2, 0):
        done = subprocess.run(line, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
        assert f"took {rows} rows" in done.stderr
    assert {r["source_status"] for r in artifact_ledger.read(spark, f"{tmp_path}/out").collect()} == {"PASS"}
