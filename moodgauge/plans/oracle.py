"""DuckDB SQL twins of the registered queries (independent formulations).

Tables ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are views.
Doubles are rounded to 6 places and integers are BIGINT, as in
``tables.normalize``.
"""

from __future__ import annotations

from ..functions.text import BANNED_KEYWORDS
from ..operators.scoring import BOOST_DECAY, NEGATION_SCALAR, NORMALIZE_ALPHA
from .config import (ENTITY_TERMS, KEYWORD_COUNT, PEER_COUNT, POSTS_PER_ENTITY,
                     QUERY_BOOSTERS, QUERY_CONTRASTS, QUERY_LEXICON, QUERY_NEGATIONS)
from ..operators.sentiment import CAPS_PUSH, CONTRAST, EXCLAIM, QUESTION
from .tables import NEWS_ITEMS_SQL, RESPONSES_SQL, SOCIAL_LISTING_SQL

ORACLE: dict[str, str] = {}

ORACLE["sentiment_report"] = """
WITH base AS (
  SELECT CAST(ts AS DATE) AS day, value AS score, event_id AS id, event_type AS grp
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
), agg AS (
  SELECT grp, day, grouping(grp) AS is_overall, count(id) AS n_posts,
         avg(score) AS score_mean, stddev_samp(score) AS score_std,
         var_samp(score) AS score_var, median(score) AS score_median
  FROM base GROUP BY GROUPING SETS ((day), (grp, day))
)
SELECT CASE WHEN is_overall = 0 THEN grp END AS report_group, day, n_posts,
       round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std,
       round(score_var, 6) AS score_var, round(score_median, 6) AS score_median,
       round(CASE WHEN count(score_std) OVER w >= 2 THEN avg(score_std) OVER w END, 6)
         AS score_std_roll
FROM agg WHERE is_overall = 1 OR grp IS NOT NULL
WINDOW w AS (PARTITION BY is_overall, grp ORDER BY day
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""

_EV_BASE = """
b AS (SELECT event_type AS grp, CAST(ts AS DATE) AS day, value AS score, event_id AS id
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))"""

ORACLE["daily_stats"] = """
SELECT CAST(ts AS DATE) AS day, count(event_id) AS n_posts,
       round(avg(value), 6) AS score_mean, round(stddev_samp(value), 6) AS score_std,
       round(var_samp(value), 6) AS score_var, round(median(value), 6) AS score_median
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
GROUP BY 1
"""

ORACLE["daily_stats_by_group"] = """
SELECT event_type AS grp, CAST(ts AS DATE) AS day, count(event_id) AS n_posts,
       round(avg(value), 6) AS score_mean, round(stddev_samp(value), 6) AS score_std,
       round(var_samp(value), 6) AS score_var, round(median(value), 6) AS score_median
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
  AND event_type IS NOT NULL
GROUP BY 1, 2
"""

ORACLE["rolling_std"] = """
WITH d AS (
  SELECT event_type AS grp, CAST(ts AS DATE) AS day, stddev_samp(value) AS score_std
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL
  GROUP BY 1, 2)
SELECT grp, day, round(score_std, 6) AS score_std,
       round(CASE WHEN count(score_std) OVER w >= 2 THEN avg(score_std) OVER w END, 6)
         AS score_std_roll
FROM d WINDOW w AS (PARTITION BY grp ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""

ORACLE["rolling_std_range"] = """
WITH d AS (
  SELECT CAST(user_id AS VARCHAR) AS grp, CAST(ts AS DATE) AS day,
         stddev_samp(value) AS score_std
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL
  GROUP BY 1, 2)
SELECT grp, day, round(score_std, 6) AS score_std,
       round(CASE WHEN count(score_std) OVER w >= 2 THEN avg(score_std) OVER w END, 6)
         AS score_std_roll
FROM d WINDOW w AS (PARTITION BY grp ORDER BY (day - DATE '1970-01-01')
                    RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)
"""

ORACLE["mean_band"] = """
WITH d AS (
  SELECT event_type AS grp, CAST(ts AS DATE) AS day, avg(value) AS m, stddev_samp(value) AS s
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL
  GROUP BY 1, 2)
SELECT grp, day, round(m, 6) AS score_mean, round(m - coalesce(s, 0), 6) AS band_lower,
       round(m + coalesce(s, 0), 6) AS band_upper
FROM d
"""

_RECENT = _EV_BASE + """,
days AS (
  SELECT grp, day, dense_rank() OVER (PARTITION BY grp ORDER BY day DESC) AS day_rank
  FROM (SELECT DISTINCT grp, day FROM b WHERE grp IS NOT NULL)),
r AS (SELECT b.grp, b.day, b.score, b.id, days.day_rank
      FROM b JOIN days ON b.grp = days.grp AND b.day = days.day WHERE days.day_rank <= 14),
q AS (
  SELECT grp, day, count(score) AS n, quantile_cont(score, 0.25) AS q1,
         quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) AS q3
  FROM r GROUP BY 1, 2),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""

ORACLE["recent_days"] = "WITH " + _RECENT + """
SELECT grp, day, round(score, 6) AS score, id, CAST(day_rank AS BIGINT) AS day_rank FROM r
"""

ORACLE["boxplot_summary"] = "WITH " + _RECENT + """
SELECT f.grp, f.day, f.n, round(f.q1, 6) AS q1, round(f.med, 6) AS median,
       round(f.q3, 6) AS q3, round(f.iqr, 6) AS iqr,
       round(min(CASE WHEN r.score BETWEEN f.lo AND f.hi THEN r.score END), 6) AS whisker_lo,
       round(max(CASE WHEN r.score BETWEEN f.lo AND f.hi THEN r.score END), 6) AS whisker_hi,
       count(CASE WHEN NOT (r.score BETWEEN f.lo AND f.hi) THEN 1 END) AS n_outliers
FROM f JOIN r ON f.grp = r.grp AND f.day = r.day
GROUP BY f.grp, f.day, f.n, f.q1, f.med, f.q3, f.iqr
"""

ORACLE["boxplot_outliers"] = "WITH " + _RECENT + """
SELECT r.grp, r.day, r.id, round(r.score, 6) AS score
FROM f JOIN r ON f.grp = r.grp AND f.day = r.day
WHERE NOT (r.score BETWEEN f.lo AND f.hi)
"""

ORACLE["daily_features"] = """
SELECT event_type AS ticker, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value_mean,
       count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
"""

# DuckDB spelling of the cleaner's whitespace class (RE2: \x{85}).
_WS = r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(0), ' '), {_WS}, ' ', 'g'))"


ORACLE["clean_text"] = f"""
SELECT doc_id, {_clean('text')} AS text_clean FROM documents
"""

ORACLE["normalize_posts"] = "WITH " + SOCIAL_LISTING_SQL + f""",
n AS (
  SELECT id, coalesce(subreddit, '') AS subreddit, coalesce(author, '') AS author,
         coalesce(created_utc, 0.0) AS created_utc,
         {_clean('title')} AS title, {_clean('selftext')} AS selftext,
         coalesce(score, 0) AS score, coalesce(num_comments, 0) AS num_comments,
         CASE WHEN starts_with(coalesce(permalink, ''), '/')
              THEN 'https://www.reddit.com' || permalink ELSE coalesce(permalink, '') END
           AS permalink,
         coalesce(url, '') AS post_url, coalesce(over_18, false) AS over_18
  FROM social_listing)
SELECT id, subreddit, author, round(created_utc, 6) AS created_utc,
       CASE WHEN created_utc <> 0
            THEN CAST(make_timestamp(CAST(round(created_utc * 1e6) AS BIGINT)) AS DATE) END
         AS date_utc,
       title, selftext, {_clean("title || chr(10) || selftext")} AS text,
       score, num_comments, permalink, post_url, over_18
FROM n
"""

ORACLE["epoch_to_date"] = """
SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS created_utc, CAST(ts AS DATE) AS date_utc
FROM events
"""

# the instant that each shape of the query's strings names, from ts itself
ORACLE["parse_iso"] = """
WITH t AS (SELECT event_id, event_id % 15 AS k, date_trunc('second', ts) AS s FROM events),
p AS (
  SELECT event_id,
         CASE WHEN k IN (0, 1, 2, 5, 8, 11) THEN s
              WHEN k = 3 THEN s - INTERVAL 2 HOUR
              WHEN k = 4 THEN s + INTERVAL 330 MINUTE
              WHEN k = 6 THEN date_trunc('day', s)
              WHEN k = 7 THEN date_trunc('minute', s)
              WHEN k = 9 THEN s + INTERVAL 123456 MICROSECOND
              WHEN k = 10 THEN s + INTERVAL 500000 MICROSECOND - INTERVAL 1 HOUR END AS published_at
  FROM t)
SELECT event_id, CAST(published_at AS TIMESTAMP) AS published_at, CAST(published_at AS DATE) AS date
FROM p WHERE published_at IS NOT NULL
"""

_PAGE_FIELDS = """
pf AS (
  SELECT page_id, url,
         chr(9) || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) AS title,
         chr(10) || regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
         array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), chr(10)) || chr(8195) AS p1,
         regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang,
         regexp_extract(url, '^(https://[^?#]*)$', 1) AS link
  FROM pages)"""

ORACLE["first_nonempty"] = "WITH " + _PAGE_FIELDS + """
SELECT page_id, coalesce(nullif(link, ''), nullif(title, ''), nullif(h1, ''), nullif(url, ''), '')
  AS value FROM pf
"""

# white space of all kinds off both ends
_ENDS = r"'^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_ENDS}, '', 'g')"


ORACLE["merge_text"] = "WITH " + _PAGE_FIELDS + f"""
SELECT page_id, concat_ws(' ', nullif({_strip('title')}, ''), nullif({_strip('h1')}, ''),
                          nullif({_strip('p1')}, '')) AS merged FROM pf
"""

ORACLE["row_id"] = "WITH " + _PAGE_FIELDS + f"""
SELECT page_id,
       'yahoo:' || substr(sha1(coalesce(nullif(link, ''),
                                        {_strip("coalesce(title, '')")} || '|' || {_strip("coalesce(p1, '')")})),
                          1, 10) || ':' || upper({_strip('lang')}) AS id
FROM pf
"""

ORACLE["date_window"] = """
SELECT event_id, event_type, round(value, 6) AS value, CAST(ts AS DATE) AS date
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
"""

ORACLE["flag_filter"] = """
SELECT d.doc_id, d.lang, d.source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE NOT coalesce(l.toxic = 1, false)
"""

ORACLE["source_filter"] = """
SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')
"""

ORACLE["truncate_tokens"] = f"""
WITH c AS (SELECT doc_id, {_clean('text')} AS t FROM documents)
SELECT doc_id,
       CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS n_tokens,
       CASE WHEN t = '' THEN '' ELSE array_to_string(string_split(t, ' ')[1:256], ' ') END
         AS text_256
FROM c
"""


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _terms_values() -> str:
    rows = []
    for e, ts in ENTITY_TERMS.items():
        rows.append(f"({_sq(e)}, -2, {_sq(e)})")
        rows.append(f"({_sq(e)}, -1, {_sq('$' + e)})")
        rows += [f"({_sq(e)}, {i}, {_sq(t)})" for i, t in enumerate(ts[:KEYWORD_COUNT]) if t]
    return "terms(entity, ord, term) AS (VALUES " + ", ".join(rows) + ")"


_MATCH = "WITH " + _terms_values() + """,
d AS (SELECT doc_id, trim(coalesce(text, '')) AS text FROM documents),
h AS (SELECT d.doc_id, d.text, t.entity, t.ord, t.term,
             strpos(lower(d.text), lower(t.term)) AS pos
      FROM d JOIN terms t ON strpos(lower(d.text), lower(t.term)) > 0
      WHERE d.text <> ''),
m AS (SELECT doc_id, entity, substr(text, pos, length(term)) AS matched_term,
             row_number() OVER (PARTITION BY doc_id, entity ORDER BY pos, ord) AS rn
      FROM h)"""

ORACLE["entity_match"] = _MATCH + """
SELECT doc_id, entity, matched_term FROM m WHERE rn = 1
"""
ORACLE["entity_match_automaton"] = ORACLE["entity_match"]


def _regex_arms() -> str:
    arms = []
    for e, ts in ENTITY_TERMS.items():
        alts = [e, "$" + e] + [t for t in ts[:KEYWORD_COUNT] if t]
        rx = "(?i)(" + "|".join("\\Q" + a + "\\E" for a in alts) + ")"
        arms.append(f"SELECT doc_id, {_sq(e)} AS entity, regexp_extract(text, {_sq(rx)}, 1) "
                    f"AS matched_term FROM d")
    return " UNION ALL ".join(arms)


ORACLE["entity_match_regex"] = f"""
WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS text FROM documents
           WHERE trim(coalesce(text, '')) <> ''),
x AS ({_regex_arms()})
SELECT doc_id, entity, matched_term FROM x WHERE matched_term <> ''
"""

ORACLE["entity_match_token"] = "WITH " + _terms_values() + """,
d AS (SELECT doc_id, text FROM documents WHERE trim(coalesce(text, '')) <> ''),
c AS (SELECT doc_id, entity, ord, ' ' || text || ' ' AS s,
             '(?is)^(.*?[^\\p{L}\\p{N}])(\\Q' || term || '\\E)[^\\p{L}\\p{N}]' AS rx
      FROM d JOIN terms t ON strpos(lower(text), lower(term)) > 0),
h AS (SELECT doc_id, entity, ord, regexp_extract(s, rx, 1) AS pre, regexp_extract(s, rx, 2) AS hit FROM c),
r AS (SELECT doc_id, entity, hit AS matched_term,
             row_number() OVER (PARTITION BY doc_id, entity ORDER BY length(pre), ord) AS rn
      FROM h WHERE hit <> '')
SELECT doc_id, entity, matched_term FROM r WHERE rn = 1
"""

ORACLE["entity_match_many_terms"] = """
WITH w AS (SELECT DISTINCT 'conv' || conv_id AS entity,
                  unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM conversations),
k AS (SELECT entity, term, row_number() OVER (PARTITION BY entity ORDER BY term) - 1 AS ord
      FROM w WHERE length(term) >= 8),
e AS (SELECT DISTINCT entity FROM k),
p AS (SELECT * FROM k UNION ALL SELECT entity, entity, -2 FROM e UNION ALL SELECT entity, '$' || entity, -1 FROM e),
t AS (SELECT DISTINCT lower(term) AS lt FROM p),
h AS (SELECT doc_id, text, lt, strpos(lower(text), lt) AS pos
      FROM documents JOIN t ON contains(lower(text), lt)),
m AS (SELECT doc_id, entity, substr(text, pos, length(lt)) AS matched_term,
             row_number() OVER (PARTITION BY doc_id, entity ORDER BY pos, ord) AS rn
      FROM h JOIN p ON lower(p.term) = h.lt)
SELECT doc_id, entity, matched_term FROM m WHERE rn = 1
"""

ORACLE["topk_per_entity"] = _MATCH + f""",
f AS (SELECT doc_id, entity, matched_term,
             row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS rank
      FROM m WHERE rn = 1)
SELECT doc_id, entity, matched_term, CAST(rank AS BIGINT) AS rank FROM f
WHERE rank <= {POSTS_PER_ENTITY}
"""

ORACLE["dedupe_first"] = """
SELECT doc_id, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE text IS NOT NULL) WHERE rn = 1
"""

ORACLE["union_pools"] = """
SELECT 'documents' AS pool, doc_id AS id, source, CAST(length(text) AS BIGINT) AS n_chars
FROM documents
UNION ALL
SELECT 'pages' AS pool, page_id AS id, NULL AS source, CAST(length(html) AS BIGINT) AS n_chars
FROM pages
"""

ORACLE["buffered_limit"] = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
           FROM events),
b AS (SELECT * FROM a WHERE rn <= 600
        AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10'),
c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn2 FROM b)
SELECT event_id, event_type, CAST(ts AS DATE) AS date FROM c WHERE rn2 <= 200
"""

ORACLE["cap_per_day"] = """
SELECT event_id, event_type, date, CAST(rank AS BIGINT) AS rank FROM (
  SELECT event_id, event_type, CAST(ts AS DATE) AS date,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE)
                            ORDER BY ts DESC, event_id DESC) AS rank
  FROM events) WHERE rank <= 50
"""


_BANNED = ", ".join(_sq(w) for w in BANNED_KEYWORDS)

_KEYWORDS = "WITH " + RESPONSES_SQL + f""",
tk AS (
  SELECT entity, run, attempt, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT entity, run, attempt,
               string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+') AS ws
        FROM responses)),
ok AS (
  SELECT entity, run, attempt, w, min(pos) AS pos FROM tk
  WHERE regexp_full_match(w, '[a-z][a-z0-9]+') AND w NOT IN ({_BANNED})
  GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity, run, attempt ORDER BY pos) AS r
       FROM ok),
kw AS (
  SELECT entity, run, attempt, string_agg(w, ' ' ORDER BY pos) AS keywords,
         count(*) AS n_keywords
  FROM rk WHERE r <= {KEYWORD_COUNT} GROUP BY ALL),
allkw AS (
  SELECT r.entity, r.run, r.attempt, coalesce(kw.keywords, '') AS keywords,
         coalesce(kw.n_keywords, 0) AS n_keywords
  FROM responses r LEFT JOIN kw
    ON kw.entity = r.entity AND kw.run = r.run AND kw.attempt = r.attempt),
acc AS (
  SELECT entity, run, attempt, keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, run ORDER BY attempt) AS a
    FROM allkw WHERE n_keywords >= {min(KEYWORD_COUNT, max(3, KEYWORD_COUNT // 2))})
  WHERE a = 1),
terms AS (
  SELECT rk.entity, rk.run, rk.w AS term, rk.r AS pos
  FROM rk JOIN acc ON acc.entity = rk.entity AND acc.run = rk.run AND acc.attempt = rk.attempt
  WHERE rk.r <= {KEYWORD_COUNT}),
firsts AS (
  SELECT entity, term, count(*) OVER (PARTITION BY entity, term) AS n_runs, run, pos,
         row_number() OVER (PARTITION BY entity, term ORDER BY run, pos) AS f
  FROM terms),
ranked AS (
  SELECT entity, term, n_runs,
         row_number() OVER (PARTITION BY entity ORDER BY n_runs DESC, run, pos, term) AS rank
  FROM firsts WHERE f = 1),
top AS (SELECT entity, CAST(rank AS BIGINT) AS rank, term, CAST(n_runs AS BIGINT) AS n_runs
        FROM ranked WHERE rank <= {KEYWORD_COUNT})"""

ORACLE["extract_keywords"] = _KEYWORDS + """
SELECT entity, run, attempt, keywords, CAST(n_keywords AS BIGINT) AS n_keywords FROM allkw
"""

ORACLE["accept_attempt"] = _KEYWORDS + """
SELECT entity, run, attempt, keywords FROM acc
"""

ORACLE["consensus_topk"] = _KEYWORDS + """
SELECT * FROM top
"""

ORACLE["expand_universe"] = _KEYWORDS + """,
base AS (SELECT entity, dense_rank() OVER (ORDER BY entity) AS bord
         FROM (SELECT DISTINCT entity FROM top)),
allp AS (
  SELECT upper(entity) AS ticker, bord, -1 AS pord FROM base
  UNION ALL
  SELECT upper(top.term) AS ticker, base.bord, top.rank AS pord
  FROM top JOIN base ON base.entity = top.entity),
ufirst AS (
  SELECT ticker, bord, pord,
         row_number() OVER (PARTITION BY ticker ORDER BY bord, pord) AS f FROM allp)
SELECT ticker, CAST(row_number() OVER (ORDER BY bord, pord, ticker) AS BIGINT) AS ord
FROM ufirst WHERE f = 1
"""

ORACLE["extract_symbols"] = "WITH " + RESPONSES_SQL + f""",
t AS (
  SELECT entity, run, attempt,
         regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'),
                        '[^\\x00-\\x7F]', '_', 'g') AS t
  FROM responses),
tk AS (
  SELECT entity, run, attempt, unnest(s) AS w, generate_subscripts(s, 1) AS pos
  FROM (SELECT *, regexp_extract_all(t, '\\b([A-Z]{{1,5}}(?:\\.[A-Z])?)\\b', 1) AS s FROM t)),
ok AS (SELECT entity, run, attempt, w, min(pos) AS pos FROM tk
       WHERE w <> upper(entity) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity, run, attempt ORDER BY pos) AS r
       FROM ok),
sy AS (SELECT entity, run, attempt, string_agg(w, ' ' ORDER BY pos) AS symbols,
              count(*) AS n FROM rk WHERE r <= {PEER_COUNT} GROUP BY ALL)
SELECT r.entity, r.run, r.attempt, coalesce(sy.symbols, '') AS symbols,
       CAST(coalesce(sy.n, 0) AS BIGINT) AS n_symbols
FROM responses r LEFT JOIN sy
  ON sy.entity = r.entity AND sy.run = r.run AND sy.attempt = r.attempt
"""


def _values(name: str, cols: str, d: dict) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join(
        f"({_sq(k)}, CAST({float(v)!r} AS DOUBLE))" for k, v in d.items()) + ")"


def _lexicon_ctes(src: str, id_col: str, text_col: str) -> str:
    """CTEs ending in ``lexs(id, neg, neu, pos, compound)`` for the rows of
    relation ``src``: tokens unnested, neighbours by ``lag``, lexicon and
    boosters by joins."""
    return (_values("lex", "w, v", QUERY_LEXICON) + ", "
            + _values("boost", "w, b", QUERY_BOOSTERS) + ", negs(w) AS (VALUES "
            + ", ".join(f"({_sq(w)})" for w in QUERY_NEGATIONS) + ")" + f""",
dt AS (SELECT {id_col} AS id,
              regexp_extract_all(lower(coalesce({text_col}, '')), '[\\p{{L}}\\p{{N}}]+') AS toks
       FROM {src}),
tk AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM dt),
lg AS (SELECT id, i, t,
              lag(t, 1) OVER (PARTITION BY id ORDER BY i) AS p1,
              lag(t, 2) OVER (PARTITION BY id ORDER BY i) AS p2,
              lag(t, 3) OVER (PARTITION BY id ORDER BY i) AS p3
       FROM tk),
v0 AS (SELECT lg.id, coalesce(lex.v, 0.0) AS v0,
              coalesce(b1.b, 0.0) * {BOOST_DECAY[0]} + coalesce(b2.b, 0.0) * {BOOST_DECAY[1]}
                + coalesce(b3.b, 0.0) * {BOOST_DECAY[2]} AS bs,
              (p1 IN (SELECT w FROM negs) OR p2 IN (SELECT w FROM negs)
                OR p3 IN (SELECT w FROM negs)) AS negated
       FROM lg LEFT JOIN lex ON lex.w = lg.t
       LEFT JOIN boost b1 ON b1.w = lg.p1
       LEFT JOIN boost b2 ON b2.w = lg.p2
       LEFT JOIN boost b3 ON b3.w = lg.p3),
v AS (SELECT id,
             (v0 + sign(v0) * bs) * CASE WHEN negated THEN {NEGATION_SCALAR} ELSE 1.0 END AS v
      FROM v0),
s AS (SELECT id, sum(v) AS s,
             sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS ps,
             abs(sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END)) AS ns,
             sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS nu
      FROM v GROUP BY id),
f AS (SELECT d.{id_col} AS id, coalesce(s.s, 0.0) AS s, coalesce(s.ps, 0.0) AS ps,
             coalesce(s.ns, 0.0) AS ns, coalesce(s.nu, 0) AS nu
      FROM {src} d LEFT JOIN s ON s.id = d.{id_col}),
lexs AS (
  SELECT id,
         CASE WHEN ps + ns + nu > 0 THEN ns / (ps + ns + nu) ELSE 0 END AS neg,
         CASE WHEN ps + ns + nu > 0 THEN nu / (ps + ns + nu) ELSE 0 END AS neu,
         CASE WHEN ps + ns + nu > 0 THEN ps / (ps + ns + nu) ELSE 0 END AS pos,
         s / sqrt(s * s + {NORMALIZE_ALPHA}) AS compound
  FROM f)""")


_LEXICON = "WITH " + _lexicon_ctes("documents", "doc_id", "text") + """
SELECT id AS doc_id, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos,
       round(compound, 6) AS compound
FROM lexs
"""

ORACLE["lexicon_score"] = _LEXICON
ORACLE["score_cache"] = _LEXICON

ORACLE["softmax_scores"] = """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) % 3 AS k FROM embeddings),
s AS (SELECT vec_id, sum(CAST(x AS DOUBLE)) FILTER (k = 1) AS p, sum(CAST(x AS DOUBLE)) FILTER (k = 2) AS n,
             sum(CAST(x AS DOUBLE)) FILTER (k = 0) AS u FROM c GROUP BY vec_id),
l AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN coalesce(p, 0) END AS p,
             CASE WHEN embedding IS NOT NULL THEN coalesce(n, 0) END AS n,
             CASE WHEN embedding IS NOT NULL THEN coalesce(u, 0) END AS u FROM embeddings LEFT JOIN s USING (vec_id)),
e AS (SELECT vec_id, exp(p - greatest(p, n, u)) AS ep, exp(n - greatest(p, n, u)) AS en,
             exp(u - greatest(p, n, u)) AS eu FROM l)
SELECT vec_id, round(en / (ep + en + eu), 6) AS neg, round(eu / (ep + en + eu), 6) AS neu,
       round(ep / (ep + en + eu), 6) AS pos,
       round(ep / (ep + en + eu) - en / (ep + en + eu), 6) AS compound
FROM e
"""

_BARS = """
bars AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         count(*) AS volume
  FROM events GROUP BY 1, 2),
ret AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS log_ret
  FROM bars),
rv AS (
  SELECT *, CASE WHEN count(log_ret) OVER w = 20
                 THEN stddev_samp(log_ret) OVER w * sqrt(252) END AS rv
  FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
lab AS (SELECT *, lead(rv, 1) OVER (PARTITION BY ticker ORDER BY date) AS rv_1d FROM rv),
social AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, avg(value) AS value_mean,
         count(*) AS n
  FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
merged AS (
  SELECT s.ticker, s.date, s.value_mean, s.n, l.log_ret, l.rv, l.rv_1d
  FROM social s JOIN lab l ON l.ticker = s.ticker AND l.date = s.date),
dates AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n
          FROM (SELECT DISTINCT date FROM merged)),
cut AS (SELECT max(date) AS cut FROM dates WHERE r <= ceil(n * 0.8 - 1e-9)),
split AS (
  SELECT merged.*, CASE WHEN date <= (SELECT cut FROM cut) THEN 'train' ELSE 'test' END AS split
  FROM merged)"""

ORACLE["ohlc_bars"] = "WITH " + _BARS + """
SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, volume FROM bars
"""

ORACLE["log_returns"] = "WITH " + _BARS + """
SELECT ticker, date, round(close, 6) AS close, round(log_ret, 6) AS log_ret FROM ret
"""

ORACLE["realized_vol"] = "WITH " + _BARS + """
SELECT ticker, date, round(log_ret, 6) AS log_ret, round(rv, 6) AS rv FROM rv
"""

ORACLE["vol_label"] = "WITH " + _BARS + """
SELECT ticker, date, round(rv, 6) AS rv, round(rv_1d, 6) AS rv_1d FROM lab
"""

ORACLE["merge_features"] = "WITH " + _BARS + """
SELECT ticker, date, round(value_mean, 6) AS value_mean, n, round(log_ret, 6) AS log_ret,
       round(rv, 6) AS rv, round(rv_1d, 6) AS rv_1d FROM merged
"""

ORACLE["time_split"] = "WITH " + _BARS + """
SELECT ticker, date, split FROM split
"""

ORACLE["fit_per_ticker"] = "WITH " + _BARS + """
SELECT ticker, round(regr_slope(rv_1d, value_mean), 6) AS slope,
       round(regr_intercept(rv_1d, value_mean), 6) AS intercept,
       CAST(regr_count(rv_1d, value_mean) AS BIGINT) AS n
FROM merged GROUP BY ticker
"""

ORACLE["evaluate"] = "WITH " + _BARS + """,
coef AS (SELECT ticker, regr_slope(rv_1d, value_mean) AS slope,
                regr_intercept(rv_1d, value_mean) AS intercept
         FROM split WHERE split = 'train' GROUP BY ticker),
pred AS (SELECT s.ticker, s.rv_1d AS y, c.intercept + c.slope * s.value_mean AS y_hat
         FROM split s JOIN coef c ON c.ticker = s.ticker WHERE s.split = 'test'),
ok AS (SELECT * FROM pred WHERE y IS NOT NULL AND y_hat IS NOT NULL)
SELECT ticker, count(*) AS n, round(avg(abs(y - y_hat)), 6) AS mae,
       round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse,
       round(1.0 - sum((y - y_hat) * (y - y_hat)) / (count(*) * var_pop(y)), 6) AS r2
FROM ok GROUP BY ticker
"""

ORACLE["session_date"] = """
WITH e AS (
  SELECT event_id, event_type AS ticker,
         (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt
  FROM events),
s AS (
  SELECT event_id, ticker,
         CASE WHEN hour(lt) * 60 + minute(lt) >= 960 THEN CAST(lt AS DATE) + 1
              ELSE CAST(lt AS DATE) END AS session_day
  FROM e),
cal AS (SELECT DISTINCT event_type AS ticker, CAST(ts AS DATE) AS d FROM events)
SELECT s.event_id, s.ticker, s.session_day,
       (SELECT min(d) FROM cal WHERE cal.ticker = s.ticker AND cal.d >= s.session_day)
         AS trade_date
FROM s
"""

ORACLE["daily_spine"] = """
WITH d AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
                  count(*) AS n FROM events GROUP BY 1, 2),
sp AS (SELECT ticker, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE)
              AS date FROM d GROUP BY ticker)
SELECT sp.ticker, sp.date, coalesce(d.n, 0) AS n
FROM sp LEFT JOIN d ON d.ticker = sp.ticker AND d.date = sp.date
"""

ORACLE["join_contract"] = """
WITH k AS (
  SELECT l_orderkey, l_linenumber, count(*) AS n,
         max(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 1 ELSE 0 END) AS hn
  FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(CASE WHEN hn = 1 THEN n END), 0) AS BIGINT) AS n_null_key_rows,
       CAST(count(CASE WHEN n > 1 AND hn = 0 THEN 1 END) AS BIGINT) AS n_dup_keys,
       CAST(coalesce(sum(CASE WHEN n > 1 AND hn = 0 THEN n END), 0) AS BIGINT) AS n_dup_rows
FROM k
"""

ORACLE["symbol_map"] = """
SELECT c.c_custkey, n.n_name AS entity, upper(substr(n.n_name, 1, 4)) AS symbol
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
"""

ORACLE["market_index_join"] = "WITH " + _BARS + """,
ix AS (SELECT CAST(ts AS DATE) AS date, arg_max(value, ts) AS index_close
       FROM events GROUP BY 1)
SELECT b.ticker, b.date, round(b.close, 6) AS close, round(ix.index_close, 6) AS index_close
FROM bars b LEFT JOIN ix ON ix.date = b.date
"""

ORACLE["stream_daily_stats"] = """
SELECT event_type AS grp, CAST(ts AS DATE) AS day, count(event_id) AS n_posts,
       round(avg(value), 6) AS score_mean, round(stddev_samp(value), 6) AS score_std,
       round(var_samp(value), 6) AS score_var
FROM events GROUP BY 1, 2
"""

ORACLE["social_report"] = "WITH " + SOCIAL_LISTING_SQL + f""",
posts AS (
  SELECT id, CASE WHEN coalesce(created_utc, 0.0) <> 0
                  THEN CAST(make_timestamp(CAST(round(created_utc * 1e6) AS BIGINT)) AS DATE)
             END AS date_utc,
         {_clean("{_t} || chr(10) || {_s}".format(_t=_clean('title'), _s=_clean('selftext')))}
           AS text,
         coalesce(over_18, false) AS over_18
  FROM social_listing),
kept AS (SELECT * FROM posts
         WHERE NOT over_18 AND id IS NOT NULL AND id <> '' AND trim(text) <> ''),
dd AS (SELECT id, text, date_utc FROM (
         SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(id AS BIGINT)) AS rn
         FROM kept) WHERE rn = 1),
{_terms_values()},
h AS (SELECT dd.id, dd.text, t.entity, t.ord, t.term,
             strpos(lower(dd.text), lower(t.term)) AS pos
      FROM dd JOIN terms t ON strpos(lower(dd.text), lower(t.term)) > 0),
m AS (SELECT id, entity, substr(text, pos, length(term)) AS matched_term,
             row_number() OVER (PARTITION BY id, entity ORDER BY pos, ord) AS rn
      FROM h),
cap AS (SELECT id, entity, matched_term FROM (
          SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CAST(id AS BIGINT)) AS r
          FROM m WHERE rn = 1) WHERE r <= {POSTS_PER_ENTITY}),
src AS (SELECT id, text FROM dd WHERE id IN (SELECT id FROM cap)),
{_lexicon_ctes("src", "id", "text")},
rws AS (
  SELECT 'reddit:' || cap.id || ':' || cap.entity AS row_id, cap.matched_term AS grp,
         dd.date_utc AS day, lexs.compound AS score
  FROM cap JOIN lexs ON lexs.id = cap.id JOIN dd ON dd.id = cap.id),
agg AS (
  SELECT grp, day, grouping(grp) AS is_overall, count(row_id) AS n_posts,
         avg(score) AS score_mean, stddev_samp(score) AS score_std,
         var_samp(score) AS score_var, median(score) AS score_median
  FROM rws WHERE day IS NOT NULL AND score IS NOT NULL
  GROUP BY GROUPING SETS ((day), (grp, day)))
SELECT CASE WHEN is_overall = 0 THEN grp END AS report_group, day, n_posts,
       round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std,
       round(score_var, 6) AS score_var, round(score_median, 6) AS score_median,
       round(CASE WHEN count(score_std) OVER w >= 2 THEN avg(score_std) OVER w END, 6)
         AS score_std_roll
FROM agg WHERE is_overall = 1 OR grp IS NOT NULL
WINDOW w AS (PARTITION BY is_overall, grp ORDER BY day
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""

ORACLE["news_rows"] = "WITH " + NEWS_ITEMS_SQL + """,
buf AS (SELECT *, row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY nth, page_id) AS rn
        FROM news_items),
parsed AS (
  SELECT page_id, event_id, nth, upper(trim(ticker)) AS ticker, title, publisher,
         coalesce(nullif(canonical, ''), nullif(click, '')) AS link,
         coalesce(nullif(description, ''), NULL) AS summary,
         CASE WHEN regexp_full_match(pub, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')
              THEN strptime(substr(pub, 1, 19), '%Y-%m-%dT%H:%M:%S') END AS published_at
  FROM buf WHERE rn <= 300),
kept AS (SELECT *, CAST(published_at AS DATE) AS date FROM parsed
         WHERE published_at IS NOT NULL
           AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
lim AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY nth, page_id) AS r2 FROM kept)
SELECT page_id, event_id, ticker, date, CAST(published_at AS TIMESTAMP) AS published_at, title, link,
       publisher, summary
FROM lim WHERE r2 <= 20
"""

ORACLE["model_score"] = """
WITH k AS (
  SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' ELSE 'neu' END AS c
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT count(*) FILTER (c = 'pos') AS n_pos, count(*) FILTER (c = 'neg') AS n_neg,
             count(*) FILTER (c = 'neu') AS n_neu FROM k),
kt AS (SELECT DISTINCT doc_id, c, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS word FROM k),
w AS (SELECT word, count(*) FILTER (c = 'pos') AS p, count(*) FILTER (c = 'neg') AS g, count(*) FILTER (c = 'neu') AS u
      FROM kt GROUP BY word),
m AS (SELECT word, ln((p + 1) / (n_pos + 2)) AS pos, ln((g + 1) / (n_neg + 2)) AS neg, ln((u + 1) / (n_neu + 2)) AS neu
      FROM w, n),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents),
s AS (SELECT doc_id, avg(pos) AS pos, avg(neg) AS neg, avg(neu) AS neu FROM t JOIN m USING (word) GROUP BY doc_id),
x AS (SELECT d.doc_id, trim(coalesce(d.text, '')) = '' AS blank, exp(coalesce(s.pos, 0)) AS pos,
             exp(coalesce(s.neg, 0)) AS neg, exp(coalesce(s.neu, 0)) AS neu
      FROM documents d LEFT JOIN s USING (doc_id))
SELECT doc_id, round(CASE WHEN blank THEN 0 ELSE neg / (pos + neg + neu) END, 6) AS neg,
       round(CASE WHEN blank THEN 1 ELSE neu / (pos + neg + neu) END, 6) AS neu,
       round(CASE WHEN blank THEN 0 ELSE pos / (pos + neg + neu) END, 6) AS pos,
       round(CASE WHEN blank THEN 0 ELSE (pos - neg) / (pos + neg + neu) END, 6) AS compound
FROM x
"""

# the same model as a plug-in
ORACLE["model_plugin"] = ORACLE["model_score"]


def _sentiment_rules() -> str:
    """The rule set with window functions inside numbered clauses."""
    run = r"'[\p{L}\p{N}]+'"
    boost = " ".join(f"WHEN '{w}' THEN {b}" for w, b in QUERY_BOOSTERS.items())
    negs = ", ".join(f"'{w}'" for w in QUERY_NEGATIONS)
    turns = ", ".join(f"'{w}'" for w in QUERY_CONTRASTS)
    push = " + ".join(
        f"coalesce((CASE p{k} {boost} END) + CASE WHEN mixed AND c{k} THEN sign(CASE p{k} {boost} END) * {CAPS_PUSH} ELSE 0 END, 0) * {d}"
        for k, d in enumerate(BOOST_DECAY, 1))
    denied = " OR ".join(f"coalesce(p{k} IN ({negs}), false)" for k in (1, 2, 3))
    return rf"""
WITH k AS (
  SELECT d.text, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS c
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
tot AS (SELECT count(*) FILTER (c = 1) AS ng, count(*) FILTER (c = 0) AS nb FROM k),
kw AS (SELECT c, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), {run}))) AS lt FROM k),
lw AS (SELECT lt, count(*) FILTER (c = 1)::DOUBLE / any_value(ng) AS g, count(*) FILTER (c = 0)::DOUBLE / any_value(nb) AS b
       FROM kw, tot GROUP BY lt HAVING count(*) >= 3),
lex AS (SELECT lt, (g - b) / (g + b) * 4 AS v1 FROM lw WHERE abs((g - b) / (g + b) * 4) >= 0.5),
items AS (SELECT item_id, regexp_extract_all(lower(text), {run}) AS w FROM benchmark),
idi AS (SELECT ph, min(v) AS v FROM (
  SELECT array_to_string(w[1:n], ' ') AS ph, CASE WHEN item_id % 2 = 0 THEN 1 ELSE -1 END * (n - 0.5) AS v
  FROM items, (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n) GROUP BY ph),
tk AS (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos
       FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+|[.,;:!?
]') AS toks FROM documents)),
cl AS (SELECT *, regexp_matches(t, '^[.,;:!?
]$') AS mark,
              sum(CASE WHEN regexp_matches(t, '^[.,;:!?
]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS clause
       FROM tk),
w0 AS (SELECT doc_id, pos, clause, lower(t) AS lt, length(t) > 1 AND regexp_matches(t, '^[\p{{Lu}}\p{{N}}]*\p{{Lu}}[\p{{Lu}}\p{{N}}]*$') AS cap
       FROM cl WHERE NOT mark),
w1 AS (SELECT *, lag(lt, 1) OVER c AS p1, lag(lt, 2) OVER c AS p2, lag(lt, 3) OVER c AS p3,
              lag(cap, 1) OVER c AS c1, lag(cap, 2) OVER c AS c2, lag(cap, 3) OVER c AS c3
       FROM w0 WINDOW c AS (PARTITION BY doc_id, clause ORDER BY pos)),
dd AS (SELECT doc_id, count(*) AS n, count(*) FILTER (cap) > 0 AND count(*) FILTER (cap) < count(*) AS mixed,
              min(pos) FILTER (lt IN ({turns})) AS turn FROM w0 GROUP BY doc_id),
v AS (SELECT w1.*, dd.mixed, dd.turn, coalesce(i3.v, i2.v, lex.v1, 0) AS v0
      FROM w1 JOIN dd USING (doc_id) LEFT JOIN lex USING (lt)
      LEFT JOIN idi i2 ON i2.ph = p1 || ' ' || w1.lt LEFT JOIN idi i3 ON i3.ph = p2 || ' ' || p1 || ' ' || w1.lt),
x0 AS (SELECT doc_id, pos, turn, v0,
              v0 + sign(v0) * CASE WHEN mixed AND cap THEN {CAPS_PUSH} ELSE 0 END + sign(v0) * ({push}) AS x,
              {denied} AS denied FROM v),
x1 AS (SELECT doc_id, CASE WHEN v0 = 0 THEN 0 ELSE
         x * CASE WHEN denied THEN {NEGATION_SCALAR} ELSE 1 END
           * CASE WHEN pos < turn THEN {CONTRAST[0]} WHEN pos > turn THEN {CONTRAST[1]} ELSE 1 END END AS x FROM x0),
sm AS (SELECT doc_id, sum(x) AS s, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END) AS ps,
              sum(CASE WHEN x < 0 THEN 1 - x ELSE 0 END) AS ns, count(*) FILTER (x = 0) AS nu FROM x1 GROUP BY doc_id),
m AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS ex,
             length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS qu FROM documents),
e AS (SELECT doc_id, coalesce(s, 0) AS s, coalesce(ps, 0) AS ps, coalesce(ns, 0) AS ns, coalesce(nu, 0) AS nu,
             least(ex, {EXCLAIM[1]}) * {EXCLAIM[0]}
             + CASE WHEN qu > {QUESTION[1]} THEN {QUESTION[2]} WHEN qu > 1 THEN qu * {QUESTION[0]} ELSE 0 END AS e
      FROM m LEFT JOIN sm USING (doc_id)),
f AS (SELECT doc_id, s + sign(s) * e AS s, ps + CASE WHEN ps > ns THEN e ELSE 0 END AS ps,
             ns + CASE WHEN ns > ps THEN e ELSE 0 END AS ns, nu FROM e)
SELECT doc_id, round(CASE WHEN ps + ns + nu > 0 THEN ns / (ps + ns + nu) ELSE 0 END, 6)::DOUBLE AS neg,
       round(CASE WHEN ps + ns + nu > 0 THEN nu / (ps + ns + nu) ELSE 0 END, 6)::DOUBLE AS neu,
       round(CASE WHEN ps + ns + nu > 0 THEN ps / (ps + ns + nu) ELSE 0 END, 6)::DOUBLE AS pos,
       round(s / sqrt(s * s + {NORMALIZE_ALPHA}), 6)::DOUBLE AS compound
FROM f
"""


ORACLE["sentiment_rules"] = _sentiment_rules()

ORACLE["merge_all"] = "WITH " + NEWS_ITEMS_SQL.strip() + """,
bars AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close
  FROM events WHERE isodow(ts) < 6 GROUP BY 1, 2),
ret AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS log_ret FROM bars),
rv AS (SELECT *, CASE WHEN count(log_ret) OVER w = 20 THEN stddev_samp(log_ret) OVER w * sqrt(252) END AS rv
       FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
lab AS (SELECT *, lead(rv) OVER (PARTITION BY ticker ORDER BY date) AS rv_1d FROM rv),
soc AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS d, value FROM events WHERE ts IS NOT NULL),
dim AS (SELECT unnest(['EN', 'FR', 'DE', 'ES']) AS entity, unnest(['click', 'view', 'purchase', 'signup']) AS symbol),
news AS (SELECT dim.symbol AS ticker, CAST(e.ts AS DATE) AS d, e.value
         FROM news_items n JOIN dim ON dim.entity = upper(n.ticker) JOIN events e ON e.event_id = n.event_id
         WHERE n.pub IS NOT NULL AND n.pub <> 'not a date'),
sd AS (SELECT ticker, date, avg(value) AS v, count(*) AS n FROM (
  SELECT ticker, value, (SELECT min(date) FROM bars b WHERE b.ticker = s.ticker AND b.date >= s.d) AS date FROM soc s)
  WHERE date IS NOT NULL GROUP BY 1, 2),
nd AS (SELECT ticker, date, avg(value) AS v, count(*) AS n FROM (
  SELECT ticker, value, (SELECT min(date) FROM bars b WHERE b.ticker = s.ticker AND b.date >= s.d) AS date FROM news s)
  WHERE date IS NOT NULL GROUP BY 1, 2)
SELECT sd.ticker, sd.date, round(sd.v, 6) AS social_value_mean, sd.n AS social_n, round(nd.v, 6) AS news_value_mean,
       nd.n AS news_n, round(log_ret, 6) AS log_ret, round(rv, 6) AS rv, round(rv_1d, 6) AS rv_1d
FROM sd JOIN nd ON nd.ticker = sd.ticker AND nd.date = sd.date JOIN lab ON lab.ticker = sd.ticker AND lab.date = sd.date
"""

# landed files: what was written comes back

ORACLE["scan_jsonl"] = """
SELECT doc_id, lang, source, n_chars, length(text) AS text_chars, sha1(text) AS text_sha1, CAST(NULL AS VARCHAR) AS bad_line FROM documents
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '{"doc_id": ' || item_id || ', "text": "' FROM benchmark
"""

ORACLE["scan_csv"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"

ORACLE["latest_snapshot"] = """
SELECT event_id, user_id, event_type, round(value, 6) AS value, props, ts FROM events
WHERE date_trunc('week', ts) = (SELECT max(date_trunc('week', ts)) FROM events)
"""

ORACLE["listing_rows"] = """
SELECT coalesce(lang, 'none') AS listing, doc_id // 100 + 1 AS page,
       row_number() OVER (PARTITION BY coalesce(lang, 'none'), doc_id // 100 ORDER BY doc_id) - 1 AS pos,
       CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
       CASE WHEN strpos(text, chr(10)) > 0 THEN length(text) - strpos(text, chr(10)) END AS selftext_chars,
       source AS subreddit, n_chars AS score
FROM documents
"""

ORACLE["entity_map_roundtrip"] = """
SELECT 'conv' || conv_id AS entity, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord,
       coalesce(regexp_extract(lower(text), '\\p{L}+'), '') AS term
FROM conversations
"""

ORACLE["price_rows"] = "WITH " + _BARS + """
SELECT upper(ticker) AS ticker, date, round(open, 6) AS adjOpen, round(high, 6) AS adjHigh, round(low, 6) AS adjLow,
       round(close, 6) AS adjClose, volume AS adjVolume FROM bars
"""

ORACLE["vix_rows"] = """
SELECT CAST(ts AS DATE) AS Date, round(arg_min(value, (ts, event_id)), 6) AS Open, round(max(value), 6) AS High,
       round(min(value), 6) AS Low, round(arg_max(value, (ts, event_id)), 6) AS Close, count(*) AS Volume
FROM events GROUP BY 1
"""

ORACLE["report_folders"] = """
WITH base AS (
  SELECT CAST(ts AS DATE) AS day, value AS score, event_id AS id, event_type AS grp,
         event_type = (SELECT min(event_type) FROM events) AS first_only
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
agg AS (
  SELECT grp, day, count(id) AS n_posts, avg(score) AS score_mean, stddev_samp(score) AS score_std,
         var_samp(score) AS score_var, median(score) AS score_median FROM base GROUP BY grp, day
  UNION ALL  -- the second run's overall report
  SELECT NULL, day, count(id), avg(score), stddev_samp(score), var_samp(score), median(score)
  FROM base WHERE NOT first_only GROUP BY day)
SELECT grp AS report_group, day, n_posts, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std,
       round(score_var, 6) AS score_var, round(score_median, 6) AS score_median,
       round(CASE WHEN count(score_std) OVER w >= 2 THEN avg(score_std) OVER w END, 6) AS score_std_roll
FROM agg WINDOW w AS (PARTITION BY grp ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""

ORACLE["strip_zone"] = """
SELECT event_id, ((ts + to_days(CAST(event_id % 365 AS INTEGER))) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ts
FROM events
"""

ORACLE["ml_predict"] = "WITH " + _BARS + """,
fit AS (SELECT regr_slope(rv_1d, value_mean) AS a, regr_intercept(rv_1d, value_mean) AS b FROM merged)
SELECT ticker, date, round(value_mean, 6) AS value_mean, round(a * value_mean + b, 6) AS prediction FROM merged, fit
"""

ORACLE["stream_resume"] = "SELECT event_id, event_type, round(value, 6) AS value, ts FROM events"
