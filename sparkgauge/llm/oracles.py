"""DuckDB SQL for queries of this subpackage that SQL can express; for tables whose doc_id are unique."""

from __future__ import annotations

from .collocations import oracle_sql as collocations_sql
from .exact_dedup import ORACLE_SQL as EXACT
from .lexical import oracle_sql as lexical_sql
from .line_dedup import WINDOW_CHARS
from .secrets import ACCESS, ASSIGN, ASSIGN_VALUE_CHARS, HEX, EntropyRules

#: Lines, windows forward and back, their first positions, lines of all other positions.
LINES = rf"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS part FROM split
), lines AS (
  SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS p, md5(line) AS key, length(line) AS size
  FROM (SELECT doc_id, no, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM raw) WHERE line <> ''
), runs AS (
  SELECT a.doc_id, a.p AS i, b.p AS j, sum(b.size) OVER (PARTITION BY a.doc_id, a.p ORDER BY b.p) AS chars
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {WINDOW_CHARS - 1}
), windows AS (
  SELECT doc_id, i, min(j) AS j FROM runs WHERE chars >= {WINDOW_CHARS} GROUP BY 1, 2
  UNION SELECT doc_id, max(i), j FROM runs WHERE chars >= {WINDOW_CHARS} GROUP BY 1, 3
  UNION SELECT doc_id, 0, max(p) FROM lines GROUP BY 1 HAVING sum(size) < {WINDOW_CHARS}
), keyed AS (
  SELECT w.doc_id, w.i, w.j, string_agg(l.key, '' ORDER BY l.p) AS key FROM windows w JOIN lines l ON l.doc_id = w.doc_id AND l.p BETWEEN w.i AND w.j GROUP BY 1, 2, 3
), firsts AS (
  SELECT key, min((doc_id, i)) AS place FROM keyed GROUP BY 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.no FROM keyed k JOIN firsts f USING (key) JOIN lines l ON l.doc_id = k.doc_id AND l.p BETWEEN k.i AND k.j WHERE (k.doc_id, k.i) <> f.place
)
SELECT d.doc_id, coalesce(len(s.parts), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_deleted, coalesce(g.nos, '') AS deleted,
  sha256(CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN split s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(no, ',' ORDER BY no) AS nos FROM gone GROUP BY 1) g USING (doc_id)
LEFT JOIN (SELECT r.doc_id, string_agg(r.part, chr(10) ORDER BY r.no) AS text FROM raw r ANTI JOIN gone USING (doc_id, no) GROUP BY 1) k USING (doc_id)
"""


def _found(kind: int, pattern: str, group: int = 0) -> str:
    """Matches of a pattern: text position of each, from the pieces between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, hits[i] AS hit, vals[i] AS val
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals, string_split_regex(t, '{p}') AS pieces FROM texts WHERE regexp_matches(t, '{p}')))"""


def secrets_sql(rules: EntropyRules = EntropyRules()) -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    bits = "CASE " + " ".join(f"WHEN regexp_matches(hit, {q(p)}) THEN {b}" for _, p, b in rules.classes) + " END"
    allowed = " OR ".join(f"regexp_matches(hit, {q(p)})" for p in rules.allow)
    w = rules.window
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, kind, start, start + length(hit) AS stop FROM (
    {_found(0, ASSIGN, 2)}) WHERE length(val) >= {ASSIGN_VALUE_CHARS}
  UNION ALL SELECT doc_id, kind, start, start + length(hit) FROM ({_found(1, ACCESS)})
  UNION ALL SELECT doc_id, kind, start, start + length(hit) FROM ({_found(2, HEX)})
), candidates AS (
  SELECT c.doc_id, c.start, c.hit, {bits} AS bits FROM ({_found(3, rules.candidate)}) c WHERE NOT ({allowed})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start <= c.start AND c.start + length(c.hit) <= b.stop)
), shifted AS (SELECT *, unnest(range(0, length(hit) - {w - 1})) AS i FROM candidates WHERE bits <= log2({w})
), letters AS (SELECT doc_id, start, bits, i, unnest(string_split(hit[i + 1:i + {w}], '')) AS c FROM shifted
), entropy AS (
  SELECT doc_id, start, bits, i, log2({w}) - sum(n * log2(n)) / {w} AS h FROM (SELECT doc_id, start, bits, i, c, count(*) AS n FROM letters GROUP BY ALL) GROUP BY ALL
), islands AS (
  SELECT doc_id, start, i, sum(CASE WHEN i - before <= {w} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, start ORDER BY i) AS run FROM (
    SELECT *, lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) AS before FROM entropy WHERE h >= bits - 1e-9)
), random AS (
  SELECT doc_id, 3 AS kind, start + min(i) AS start, start + max(i) + {w} AS stop FROM islands GROUP BY doc_id, islands.start, run
), every AS (SELECT * FROM base UNION ALL SELECT * FROM random),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM every)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind, stop), '') AS spans, count(*) FILTER (kind = 3) AS n_entropy
FROM documents d LEFT JOIN named n USING (doc_id) GROUP BY 1
"""


ORACLE_SQL: dict[str, str] = {"op4_line_winnowing": LINES, "op6_cuckoo_dedup": EXACT, "op9_entropy_secrets": secrets_sql(), "op11_phrase_hashing": collocations_sql(), "op13_bit_sliced": lexical_sql()}
