"""Column-level text functions (rows C1, C5-C8, H5, G1/G2 tokenisers).

All of them return a ``Column`` built from built-in functions, so they stay
inside whole-stage code generation and run wherever the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.isspace`` written as a
# Java regex class, plus NUL (which the cleaner maps to a space first).
# Java's own (?U)\s misses \x1c-\x1f, so the class is spelled out.
WHITESPACE = "\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}"
WHITESPACE_RUN = f"[\\x00{WHITESPACE}]+"
# The same class without NUL, at either end of a string.
STRIP_ENDS = f"^[{WHITESPACE}]+|[{WHITESPACE}]+\\z"

# Words never accepted as keywords.
BANNED_KEYWORDS = ["stock", "price", "market", "trading", "investing",
                   "investment", "news", "analysis"]

# Prefix of site-relative social permalinks.
SOCIAL_SITE = "https://www.reddit.com"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """All white space off both ends, as Python's ``str.strip``. Texts whose
    first and last character are none are taken as they are."""
    c = _c(col)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(f"[{WHITESPACE}]"), F.regexp_replace(c, STRIP_ENDS, "")).otherwise(c)


def clean_text(col) -> Column:
    """Null -> '', NUL -> space, whitespace runs -> one space, trimmed."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def blank_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


def first_nonempty(*cols) -> Column:
    """First value that is neither null nor empty ('' when none)."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def merge_text(*cols) -> Column:
    """Strip each field, skip empty ones, join with one space."""
    return F.concat_ws(" ", *[blank_to_null(strip(c)) for c in cols])


def norm_ticker(col) -> Column:
    """Upper-case and strip a ticker symbol."""
    return F.upper(strip(col))


def row_id(prefix: str, link, title, summary, ticker) -> Column:
    """``{prefix}:{sha1(base)[:10]}:{ticker}``.

    ``base`` is the link, or ``strip(title)|strip(summary)`` when the link is
    empty.
    """
    base = F.coalesce(
        blank_to_null(_c(link)),
        F.concat(strip(F.coalesce(_c(title), F.lit(""))), F.lit("|"),
                 strip(F.coalesce(_c(summary), F.lit("")))),
    )
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(base), 1, 10),
                    F.lit(":"), _c(ticker))


def site_permalink(col, site: str = SOCIAL_SITE) -> Column:
    """Prefix site-relative permalinks ('/r/...') with the site."""
    p = F.coalesce(_c(col), F.lit(""))
    return F.when(p.startswith("/"), F.concat(F.lit(site), p)).otherwise(p)


def truncate_tokens(col, n: int = 256, cleaned: bool = False) -> Column:
    """H5: first ``n`` whitespace tokens of the cleaned text, re-joined.
    ``cleaned=True`` when ``col`` already went through ``clean_text``."""
    c = _c(col) if cleaned else clean_text(col)
    return F.when(c == "", F.lit("")).otherwise(
        F.array_join(F.slice(F.split(c, " "), 1, n), " "))


def token_count(col, cleaned: bool = False) -> Column:
    c = _c(col) if cleaned else clean_text(col)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("bigint")


def word_tokens(col) -> Column:
    """Lower-cased letter/digit runs (used by the lexicon scorer and the
    token matcher)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))),
                                F.lit("[\\p{L}\\p{N}]+"), 0)


def keyword_candidates(col) -> Column:
    """G1 tokeniser: whole words ``[a-z][a-z0-9]+`` of the lower-cased text.

    A word counts only if its Unicode word (letters, digits, ``_``) is all
    ASCII, as with a Unicode ``\\b`` around the pattern.
    """
    words = F.split(F.lower(F.coalesce(_c(col), F.lit(""))),
                    "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z][a-z0-9]+$"))


def symbol_candidates(col) -> Column:
    """G2 tokeniser: ``[A-Z]{1,5}`` with an optional ``.X`` suffix,
    case-sensitive, bounded by Unicode word boundaries.

    Non-ASCII letters and digits become ``_`` (a word character) and other
    non-ASCII characters a space, after which ASCII boundaries behave like
    Unicode ones.
    """
    t = F.coalesce(_c(col), F.lit(""))
    t = F.regexp_replace(t, "[^\\x00-\\x7F\\p{L}\\p{N}]", " ")
    t = F.regexp_replace(t, "[^\\x00-\\x7F]", "_")
    return F.regexp_extract_all(t, F.lit("\\b([A-Z]{1,5}(?:\\.[A-Z])?)\\b"), 1)


def ordered_distinct_head(arr: Column, k: int, drop: list[str] | Column | None = None) -> Column:
    """Distinct elements in first-seen order, minus ``drop``, first ``k``."""
    if drop is not None:
        if isinstance(drop, list):
            drop_arr = F.array(*[F.lit(x) for x in drop]) if drop else F.array().cast("array<string>")
        else:
            drop_arr = drop
        arr = F.filter(arr, lambda w: ~F.array_contains(drop_arr, w))
    return F.slice(F.array_distinct(arr), 1, k)
