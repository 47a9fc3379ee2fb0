"""Row filters (D1-D5). All are plain predicates, pushed into the scan by
Catalyst where the column comes straight from Parquet."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def date_window(df: DataFrame, col: str, start: str | None = None,
                end: str | None = None, today: str | None = None) -> DataFrame:
    """Keep rows whose calendar date lies in ``[start, end]`` inclusive.

    Defaults: end = today, start = end - 7 days; swapped bounds are put in
    order. Bounds are literals, so the predicate reaches the Parquet scan.
    """
    end_d = _dt.date.fromisoformat(end) if end else (
        _dt.date.fromisoformat(today) if today else _dt.date.today())
    start_d = _dt.date.fromisoformat(start) if start else end_d - _dt.timedelta(days=7)
    lo, hi = min(start_d, end_d), max(start_d, end_d)
    c = F.col(col)
    # compare on the raw column (timestamp or date) so the filter pushes down
    return df.where((c >= F.lit(lo)) & (c < F.lit(hi + _dt.timedelta(days=1))))


def flag_filter(df: DataFrame, flag_col: str = "over_18", include: bool = False) -> DataFrame:
    """Drop flagged (adult) rows unless ``include``; a null flag is not
    flagged."""
    if include:
        return df
    return df.where(~F.coalesce(F.col(flag_col), F.lit(False)))


def drop_blank(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """D3: drop rows without an id or with blank text (white space only)."""
    idc = F.col(id_col)
    return df.where(idc.isNotNull() & (idc.cast("string") != "")
                    & (strip(F.coalesce(F.col(text_col), F.lit(""))) != ""))


def source_filter(df: DataFrame, lang: str | None = "en",
                  sources: list[str] | None = None,
                  lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Language and source allow-lists (None = no restriction)."""
    cond = F.lit(True)
    if lang is not None:
        cond = cond & (F.col(lang_col) == lang)
    if sources is not None:
        cond = cond & F.col(source_col).isin(list(sources))
    return df.where(cond)
