"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

ORACLE["op8_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS} AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
              + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
              + CASE WHEN 10 * n_dup_lines > n_words THEN 8 ELSE 0 END
              + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END
              + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept, fail_bits FROM f
"""


def _assigned(name: str, books: str) -> str:
    """Nearest entry of every part, by trying all: (rid, part, p, idx, d)."""
    return f"""{name} AS (
  SELECT rid, part, any_value(p) AS p, min(struct_pack(d := d, idx := idx)) AS best FROM (
    SELECT parts.rid, parts.part, parts.p, b.idx,
           list_sum(list_transform(list_zip(parts.p, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
    FROM parts JOIN {books} b USING (part)) GROUP BY rid, part)"""


def _moved(name: str, assigned: str, books: str) -> str:
    """Entries replaced by the floor means of their parts."""
    return f"""{name} AS (
  SELECT b.part, b.idx, coalesce(m.e, b.e) AS e FROM {books} b LEFT JOIN (
    SELECT part, idx, list(c ORDER BY pos) AS e FROM (
      SELECT part, best.idx AS idx, pos, floor(sum(p[pos]) / count(*))::BIGINT AS c
      FROM {assigned}, (SELECT unnest(range(1, len(p) + 1)) AS pos FROM (SELECT p FROM parts LIMIT 1))
      GROUP BY part, best.idx, pos) GROUP BY part, idx) m USING (part, idx))"""


ORACLE["op12_vector_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS p
  FROM kept, (SELECT unnest(range(0, 16)) AS part)),
b0 AS (SELECT part, rid AS idx, p AS e FROM parts WHERE rid < 64),
{_assigned("a0", "b0")}, {_moved("b1", "a0", "b0")},
{_assigned("a1", "b1")}, {_moved("b2", "a1", "b1")},
{_assigned("a2", "b2")},
codes AS (
  SELECT rid, string_agg(printf('%02x', best.idx), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, idx)) FROM b2) AS codebooks_sha256
FROM kept JOIN codes USING (rid)
"""
