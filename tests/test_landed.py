"""Scans and sinks over landed files: the cases behind the registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodgauge.sinks import files as sinks
from moodgauge.sources import files as src
from moodgauge.streaming import landing


def test_bad_lines_are_counted_in_the_same_pass(spark, tmp_path):
    p = str(tmp_path / "x.jsonl")
    with open(p, "w") as f:
        f.write('{"id": 1, "t": "a"}\n\n{"id": 2, "t": \n{"id": 3, "t": null}\nnot json\n{"id": "x"}\n')
    schema = spark.createDataFrame([], "id long, t string").schema
    got = [tuple(r) for r in src.scan_jsonl(spark, p, schema).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a", None), (3, None, None), (None, None, '{"id": 2, "t": '), (None, None, "not json"),
                                            (None, None, '{"id": "x"}')], key=repr)
    with pytest.raises(Exception):
        src.read_jsonl(spark, p, schema).collect()


def test_csv_gives_every_text_back(spark, tmp_path):
    texts = [None, "", " ", '"', '""', "a,b", "a\nb", "a\r\nb", "\ta ", "\\", '\\"', "#x", "é☃", 'x"y,"\n"z', "null", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sinks.write_csv(df.repartition(3), str(tmp_path / "c"))
    assert sorted(map(tuple, src.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == list(enumerate(texts))


def test_newest_snapshot_opens_its_files_only(spark, tmp_path):
    rows = [(i, f"news_2024-0{1 + i % 3}-01_2024-0{1 + i % 3}-08") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, snapshot string").repartition(1)
    df.write.partitionBy("snapshot").json(str(tmp_path / "s"))
    for old in ("news_2024-01-01_2024-01-08", "news_2024-02-01_2024-02-08"):
        with open(str(tmp_path / "s" / f"snapshot={old}" / "part-x.json"), "w") as f:
            f.write("not json\n")       # would fail the job if it were read
    got = src.newest_snapshot(spark, str(tmp_path / "s"), "snapshot=news_*", df.drop("snapshot").schema)
    assert sorted(r.id for r in got.collect()) == [i for i in range(30) if i % 3 == 2]
    with pytest.raises(FileNotFoundError):
        src.newest_snapshot(spark, str(tmp_path / "s"), "other_*", df.schema)


def test_entity_maps_of_bounded_size(spark, tmp_path):
    rows = [(f"e{i}", j, f"t{i * j % 5}") for i in range(20) for j in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "entity string, ord int, term string")
    sinks.write_entity_terms(df, str(tmp_path / "m"), max_entities=3)
    assert sorted(map(tuple, src.read_entity_terms(spark, str(tmp_path / "m")).collect())) == sorted(rows)
    assert len(list((tmp_path / "m").glob("map=*"))) > 3


def test_price_lists_fail_in_the_plan(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.json").write_text('[{"date": "2024-01-02T00:00:00.000Z", "adjClose": 1.5}]')
    got = src.read_prices(spark, str(tmp_path / "p"), eager=False).first()
    assert (got.ticker, got.date, got.adjClose) == ("ABC", dt.date(2024, 1, 2), 1.5)
    for payload in ("[]", " [ ] ", '{"detail": "no"}'):
        (tmp_path / "p" / "bad.json").write_text(payload)
        with pytest.raises(Exception, match="not a list of rows"):
            src.read_prices(spark, str(tmp_path / "p"), eager=False).collect()


def test_second_report_replaces_its_groups_only(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    schema = "report_group string, day date, n_posts long"
    first = spark.createDataFrame([("a", day, 1), ("b", day, 2), ("7", day, 3), (None, day, 6)], schema)
    sinks.write_report(first, str(tmp_path / "r"), replace="groups")
    sinks.write_report(spark.createDataFrame([("b", day, 5), (None, day, 9)], schema), str(tmp_path / "r"), replace="groups")
    read = spark.createDataFrame([], "day date, n_posts long, report_group string").schema
    got = {r.report_group: r.n_posts for r in src.read_report(spark, str(tmp_path / "r"), read).collect()}
    assert got == {"a": 1, "b": 5, "7": 3, None: 9}


def test_resumed_stream_keeps_bounded_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i)) for i in range(240)]
    again = rows[110:120]       # lands in both runs
    out, state = str(tmp_path / "out"), {}
    for part in (rows[:120], rows[120:] + again):
        spark.createDataFrame(part, "id long, ts timestamp").write.mode("append").json(str(tmp_path / "landing"))
        with landing.rocksdb_state(spark):
            s = landing.stream_landing(spark, str(tmp_path / "landing"), "id long, ts timestamp", delay="1 day")
            landing.run_available(s, str(tmp_path / "cp"), out, strict=True, seen=state)
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == list(range(240))
    # ids older than the delay have left the state
    assert state["state_rows"] < 240 and got.where(F.col("ts").isNull()).count() == 0
