"""Plan shapes that the scale design relies on."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from moodgauge.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF).explain("formatted")
    return buf.getvalue()


def test_date_window_pushed_to_scan(spark):
    p = plan(spark, "date_window")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,2024-01-10", p)
    assert "LessThan(ts,2024-01-21" in p


def test_theta_match_never_shuffles_documents(spark):
    p = plan(spark, "entity_match")
    head = p[:p.find("\n\n(1)")]
    assert "BroadcastNestedLoopJoin" in head and "BroadcastExchange" in head
    # the document side is Scan -> Filter -> Project straight into the join
    doc_side = head.split("BroadcastNestedLoopJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in doc_side
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


@pytest.mark.parametrize("name", ["topk_per_entity", "dedupe_first", "consensus_topk"])
def test_partial_topk_before_shuffle(spark, name):
    head = plan(spark, name)
    head = head[:head.find("\n\n(1)")]
    lines = head.splitlines()
    ex = [i for i, l in enumerate(lines) if "Exchange" in l and "Broadcast" not in l]
    wgl = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l]
    # a WindowGroupLimit below (after, in print order) the top-k exchange
    assert len(wgl) >= 2 and any(w > ex[0] for w in wgl)


def test_report_partial_aggregation_after_expand(spark):
    head = plan(spark, "sentiment_report")
    head = head[:head.find("\n\n(1)")]
    lines = [l.strip(" +-:*") for l in head.splitlines()]
    i = next(i for i, l in enumerate(lines) if l.startswith("Expand"))
    assert any("Aggregate" in l for l in lines[i - 3:i]) and "Exchange" in " ".join(lines[:i])


def test_lexicon_hash_join(spark):
    p = plan(spark, "lexicon_score")
    assert "BroadcastHashJoin" in p and "BroadcastNestedLoopJoin" not in p


def test_column_pruning(spark):
    p = plan(spark, "clean_text")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_row_at_a_time_python(spark):
    for name in QUERIES:
        if name == "stream_daily_stats":
            continue
        p = plan(spark, name)
        assert "BatchEvalPython" not in p, name
        if name != "model_score":
            assert "MapInPandas" not in p and "ArrowEvalPython" not in p, name
