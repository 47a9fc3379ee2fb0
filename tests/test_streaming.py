"""Landing-folder stream (X1, X2): stream equals batch; watermark drops late
rows across micro-batches."""

import datetime as dt
import json
import itertools
import os

import pytest
from pyspark.sql import functions as F

from moodgauge.operators import report
from moodgauge.streaming import landing

SCHEMA = "id long, ts timestamp, grp string, score double"


def _land(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def _row(i, day, hour, grp, score):
    return {"id": i, "ts": f"2024-01-{day:02d}T{hour:02d}:00:00Z", "grp": grp, "score": score}


def test_stream_equals_batch(spark, tmp_path):
    land = str(tmp_path / "land")
    _land(land, "a.json", [_row(1, 1, 1, "x", 0.5), _row(2, 1, 2, "x", 0.1),
                           _row(3, 2, 3, "y", 0.3), _row(3, 2, 3, "y", 0.3)])  # duplicate id
    s = landing.stream_landing(spark, land, SCHEMA, "ts", "id", "1 day")
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    out = str(tmp_path / "out")
    landing.run_complete_to_table(stats, str(tmp_path / "ck"), out)
    got = {(r["grp"], str(r["day"])): (r["n_posts"], r["score_mean"])
           for r in spark.read.parquet(out).collect()}
    batch = report.daily_stats(spark.read.schema(SCHEMA).json(land).dropDuplicates(["id"]),
                               "ts", "score", "id", group="grp")
    want = {(r["grp"], str(r["day"])): (r["n_posts"], r["score_mean"]) for r in batch.collect()}
    assert got == want


def test_watermark_drops_late_rows(spark, tmp_path):
    land = str(tmp_path / "land")
    _land(land, "1.json", [_row(1, 10, 12, "x", 1.0)])
    s = landing.stream_landing(spark, land, SCHEMA, "ts", "id", "1 hour",
                               max_files_per_trigger=1)
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    landing.run_complete_to_table(stats, ck, out)
    # a row three days older than the watermark arrives later: dropped by the
    # de-duplication stage, so no 2024-01-07 window appears
    _land(land, "2.json", [_row(2, 7, 12, "x", 5.0), _row(3, 10, 13, "x", 3.0)])
    assert landing.run_complete_to_table(stats, ck, out) == 1
    got = {str(r["day"]): r["n_posts"] for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-10": 2}


def test_append_mode_emits_closed_windows_only(spark, tmp_path):
    land = str(tmp_path / "land")
    _land(land, "1.json", [_row(1, 10, 12, "x", 1.0), _row(2, 10, 13, "x", 3.0)])
    s = landing.stream_landing(spark, land, SCHEMA, "ts", "id", "1 hour",
                               max_files_per_trigger=1)
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    landing.run_available(stats, ck, out)
    # the watermark (max ts - 1 hour) has not passed the end of 2024-01-10 yet
    assert spark.read.schema(stats.schema).parquet(out).count() == 0
    _land(land, "2.json", [_row(3, 12, 6, "x", 2.0)])
    landing.run_available(stats, ck, out)
    got = {str(r["day"]): (r["n_posts"], r["score_mean"]) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-10": (2, 2.0)}


FILES = [[_row(1, 1, 1, "x", 0.5), _row(2, 2, 2, "x", 0.1)], [_row(3, 9, 3, "y", 0.3), _row(1, 1, 1, "x", 0.5)],
         [_row(4, 20, 3, "y", 0.7)]]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_one_file_batches_equal_the_batch_answer_in_any_order(spark, tmp_path, order):
    land = str(tmp_path / "land")
    for i, k in enumerate(order):       # files are taken by modification time
        _land(land, f"{i}.json", FILES[k])
        os.utime(os.path.join(land, f"{i}.json"), (1_700_000_000 + 60 * i,) * 2)
    s = landing.stream_landing(spark, land, SCHEMA, "ts", "id", "30 days", max_files_per_trigger=1)
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    out = str(tmp_path / "out")
    assert landing.run_complete_to_table(stats, str(tmp_path / "ck"), out, strict=True) == 0
    got = {(r["grp"], str(r["day"])): r["n_posts"] for r in spark.read.parquet(out).collect()}
    assert got == {("x", "2024-01-01"): 1, ("x", "2024-01-02"): 1, ("y", "2024-01-09"): 1, ("y", "2024-01-20"): 1}


def test_bounded_run_fails_rather_than_lose_rows(spark, tmp_path):
    land = str(tmp_path / "land")
    for i, k in enumerate((2, 0, 1)):
        _land(land, f"{i}.json", FILES[k])
        os.utime(os.path.join(land, f"{i}.json"), (1_700_000_000 + 60 * i,) * 2)
    s = landing.stream_landing(spark, land, SCHEMA, "ts", "id", "1 day", max_files_per_trigger=1)
    stats = landing.stream_daily_stats(s, "ts", "score", "grp", "id")
    with pytest.raises(landing.LateRows):
        landing.run_complete_to_table(stats, str(tmp_path / "ck"), str(tmp_path / "out"), strict=True)
