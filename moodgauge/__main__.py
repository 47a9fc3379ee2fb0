"""Command line for the file-to-file jobs (one subcommand per entry point of
the surveyed project).

    python -m moodgauge consensus-terms --responses R --out keywords.json --k 5
    python -m moodgauge consensus-terms --responses R --out peers.json --k 6 --kind peers
    python -m moodgauge social-posts --pages P --terms keywords.json --out matched
    python -m moodgauge score-posts --in matched --out scored --lexicon lexicon.csv
    python -m moodgauge score-news --raw-dir raw/news --weights weights.parquet --out news_scored
    python -m moodgauge report --scored scored --out reports/vader --group match_term
    python -m moodgauge labels --prices px.json --ticker NVDA --out labels
    python -m moodgauge merge --social S --news N --labels L --out merged

On a cluster, call ``moodgauge.__main__.main([...])`` from the script given
to ``spark-submit`` (with ``--py-files moodgauge.zip``); without
``--master`` the session builder picks up the cluster's settings, including
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import json

from . import jobs
from .session import build_session


def _lexicon(spark, path: str):
    """A (word, valence) table: CSV with header ``word,valence`` or a
    tab-separated file without header."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema("word string, valence double").csv(path)
    return spark.read.option("sep", "\t").schema("word string, valence double").csv(path)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="moodgauge")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    ap.add_argument("--overwrite", action="store_true", help="replace existing output")
    sub = ap.add_subparsers(dest="cmd", required=True)

    c = sub.add_parser("consensus-terms")
    c.add_argument("--responses", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--k", type=int, default=5)
    c.add_argument("--kind", choices=["keywords", "peers"], default="keywords")

    s = sub.add_parser("social-posts")
    s.add_argument("--pages", required=True, nargs="+", help="one folder per source, in fetch order")
    s.add_argument("--terms", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--k", type=int, default=15)
    s.add_argument("--cap", type=int, default=200)
    s.add_argument("--include-flagged", action="store_true")

    sp = sub.add_parser("score-posts")
    sp.add_argument("--in", dest="inp", required=True)
    sp.add_argument("--out", required=True)
    sp.add_argument("--lexicon", required=True)
    sp.add_argument("--session", action="store_true")

    sn = sub.add_parser("score-news")
    sn.add_argument("--raw-dir", required=True)
    sn.add_argument("--weights", required=True, help="Parquet table of word, pos, neg, neu")
    sn.add_argument("--out", required=True)

    r = sub.add_parser("report")
    r.add_argument("--scored", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--group", default=None)
    r.add_argument("--date-col", default="date")
    r.add_argument("--score-col", default="compound")
    r.add_argument("--rows", type=int, default=5)

    lb = sub.add_parser("labels")
    lb.add_argument("--prices", required=True)
    lb.add_argument("--ticker", default=None, help="default: the name of each price file")
    lb.add_argument("--vix", default=None)
    lb.add_argument("--out", required=True)
    lb.add_argument("--window", type=int, default=20)
    lb.add_argument("--horizon", type=int, default=1)

    m = sub.add_parser("merge")
    m.add_argument("--social", required=True)
    m.add_argument("--news", required=True)
    m.add_argument("--labels", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--how", default="inner")
    m.add_argument("--names", nargs="*", default=None)
    m.add_argument("--symbols", nargs="*", default=None)

    a = ap.parse_args(argv)
    spark = build_session(a.master)
    result: dict = {"cmd": a.cmd}
    if a.cmd == "consensus-terms":
        result["terms"] = jobs.consensus_terms_job(spark, a.responses, a.out, a.k, a.kind,
                                                      overwrite=a.overwrite).count()
    elif a.cmd == "social-posts":
        result["rows"] = jobs.social_posts_job(spark, a.pages, a.terms, a.out, a.k, a.cap,
                                               a.include_flagged, overwrite=a.overwrite)
    elif a.cmd == "score-posts":
        result["rows"] = jobs.score_posts_job(spark, a.inp, a.out, _lexicon(spark, a.lexicon),
                                              session=a.session, overwrite=a.overwrite)
    elif a.cmd == "score-news":
        result["rows"] = jobs.score_news_job(spark, a.raw_dir, a.out, weights=spark.read.parquet(a.weights),
                                             overwrite=a.overwrite)
    elif a.cmd == "report":
        jobs.report_job(spark, a.scored, a.out, a.date_col, a.score_col, a.group, rows=a.rows,
                        overwrite=a.overwrite)
    elif a.cmd == "labels":
        jobs.labels_job(spark, a.prices, a.ticker, a.out, a.window, horizon=a.horizon,
                        vix_path=a.vix, overwrite=a.overwrite)
    elif a.cmd == "merge":
        jobs.merge_job(spark, a.social, a.news, a.labels, a.out, a.how, a.names, a.symbols,
                       overwrite=a.overwrite)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
