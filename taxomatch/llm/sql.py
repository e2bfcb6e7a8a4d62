"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_VALID = ("SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 "
          "AND len(list_filter(embedding, lambda x: x <> 0)) > 0")

OP3 = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank, role, text,
    len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]')) AS n,
    3 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?(?:s>|INST\]|SYS>))', '\1\\\2\3', 'g')) + 1
      + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS>))', '\1\\\2\3', 'g')) + 4 AS chars
  FROM said
), leads AS (SELECT conv_id, min(rank) AS rank, arg_min(n, rank) AS n, arg_min(chars, rank) AS chars FROM turns WHERE role = 'system' GROUP BY conv_id
), sized AS (
  SELECT t.*, sum(t.n) OVER (PARTITION BY t.conv_id, t.rank // 256 ORDER BY t.rank) AS upto, greatest(1, 512 - 128 - coalesce(l.n, 0)) AS room
  FROM turns t LEFT JOIN leads l ON t.conv_id IS NOT DISTINCT FROM l.conv_id
), walk AS (
  SELECT conv_id, rank, rank AS first, 0::HUGEINT AS base, upto FROM sized WHERE rank % 256 = 0
  UNION ALL
  SELECT s.conv_id, s.rank, CASE WHEN s.upto - w.base > s.room AND w.upto > w.base THEN s.rank ELSE w.first END,
    CASE WHEN s.upto - w.base > s.room AND w.upto > w.base THEN w.upto ELSE w.base END, s.upto
  FROM walk w JOIN sized s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.rank = w.rank + 1 AND s.rank % 256 <> 0
), firsts AS (SELECT DISTINCT conv_id, first FROM walk WHERE first > 0
), history AS (
  SELECT f.conv_id, t.chars, sum(t.n) OVER (PARTITION BY f.conv_id, f.first ORDER BY t.rank DESC) AS upto
  FROM firsts f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.rank < f.first AND t.rank >= f.first - 8 LEFT JOIN leads l ON l.conv_id IS NOT DISTINCT FROM f.conv_id
  WHERE t.rank IS DISTINCT FROM l.rank
), repeated AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM history WHERE upto <= 128
    UNION ALL SELECT f.conv_id, l.chars FROM firsts f JOIN leads l ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND l.rank < f.first) GROUP BY conv_id
), summed AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS target, sum(chars) AS chars
  FROM turns GROUP BY conv_id
)
SELECT s.conv_id, n_turns, turns_sha256, length(target)::BIGINT AS loss_chars, sha256(target) AS loss_sha256, (s.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM summed s LEFT JOIN repeated r ON s.conv_id IS NOT DISTINCT FROM r.conv_id
"""

OP5 = f"""
WITH RECURSIVE v AS ({_VALID}), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_sum(list_transform(list_zip(x.e, y.e), lambda p: p[1] * p[2])) / (x.norm * y.norm) >= 0.95
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN counts c ON e.vec_id = c.a
"""

OP7 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (
  SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)
), often AS (SELECT h FROM places WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
flagged AS (
  SELECT doc_id, i, word, max(CASE WHEN o.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM places p LEFT JOIN often o ON p.h = o.h
), summed AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM flagged GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN summed s ON w.doc_id = s.doc_id
"""

OP9 = f"""
WITH v AS MATERIALIZED (SELECT *, row_number() OVER () AS own FROM ({_VALID}) WHERE vec_id IS NOT NULL), scored AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.norm * c.norm) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.own <> c.own AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP11 = rf"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n AS c FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT doc_id, 0 AS k, 4294967295::BIGINT AS c FROM documents
  UNION ALL SELECT doc_id, crc.k + 1, xor(b.c, crc.c >> 8) FROM crc JOIN bits b ON b.k = 8 AND b.n = xor(crc.c & 255, ascii(substr(doc_id::VARCHAR, crc.k + 1, 1))) WHERE crc.k < length(doc_id::VARCHAR)
), hashed AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = length(doc_id::VARCHAR)
), plain AS (
  SELECT d.doc_id, {_WORDS} AS ws, h FROM documents d JOIN hashed h ON d.doc_id = h.doc_id
), cuts AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM plain
), steps AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cuts
), words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_concat(ws[:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) END AS ws FROM steps
), places AS (
  SELECT doc_id, n, i, ws[i + 1] AS word, CASE WHEN i + 16 <= n THEN md5(array_to_string(ws[i + 1:i + 16], ' ')) END AS gram
  FROM (SELECT doc_id, n, ws, unnest(range(n)) AS i FROM words)
), seeds AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM seeds
), stretches AS (SELECT doc_id, q, min(i) AS s, max(i) + 16 AS e FROM islands GROUP BY doc_id, q, island
), whole AS (
  SELECT doc_id, s, e + q AS ends, min(q) AS q FROM stretches WHERE e - s >= greatest(24 - q, 2 * q) GROUP BY doc_id, s, e + q
), ranked AS (
  SELECT *, ends - s AS n, row_number() OVER (PARTITION BY doc_id ORDER BY (ends - s) / q DESC, s, q) AS rank FROM whole
), told AS (
  SELECT doc_id, count(*) AS n_runs, max(s) FILTER (rank = 1) AS start, max(n) FILTER (rank = 1) AS length, max(q) FILTER (rank = 1) AS period,
    string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM ranked GROUP BY doc_id
), edges AS (
  SELECT doc_id, place, sum(d) AS d FROM (SELECT doc_id, s + q AS place, 1 AS d FROM whole UNION ALL SELECT doc_id, ends, -1 FROM whole) GROUP BY doc_id, place
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (
    SELECT p.doc_id, p.i, p.word, sum(coalesce(e.d, 0)) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS inside
    FROM places p LEFT JOIN edges e ON p.doc_id = e.doc_id AND p.i = e.place) WHERE inside = 0 GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM words w LEFT JOIN told t ON w.doc_id = t.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

_P = 2147483647
_ROUNDS = [48271 + 2 * 7919 * k * k for k in range(1, 13)]


def _fifth(name: str, x: str, new: str, source: str) -> str:
    """Steps that add ``new``: x to the fifth, modulo the prime."""
    return f"""{name}a AS (SELECT *, ({x}) % {_P} AS x1 FROM {source}), {name}b AS (SELECT *, x1 * x1 % {_P} AS x2 FROM {name}a),
{name} AS (SELECT * EXCLUDE (x1, x2), x2 * x2 % {_P} * x1 % {_P} AS {new} FROM {name}b)"""


def _permute(source: str, out: str) -> str:
    """Steps that move x by rounds of exchanges between partners."""
    steps = []
    for k, c in enumerate(_ROUNDS):
        steps.append(f"""{out}p{k} AS (SELECT *, ((seed * {c} % {_P} % "full" - x) % "full" + "full") % "full" AS partner FROM {source}), {out}m{k} AS (SELECT *, (greatest(x, partner) % {_P} * {c} + seed) % {_P} AS mark FROM {out}p{k}),
{out}{k} AS (SELECT * EXCLUDE (partner, mark) REPLACE (CASE WHEN mark * mark % {_P} % 2 = 1 THEN partner ELSE x END AS x) FROM {out}m{k})""")
        source = f"{out}{k}"
    return ",\n".join(steps)


OP13 = rf"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS row, doc_id, source AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT name, size, row_number() OVER (ORDER BY name IS NULL, encode(name)) - 1 AS source FROM (SELECT name, sum(size)::BIGINT AS size FROM sized GROUP BY name)
), weighed AS (SELECT *, source % 3 + 1 AS weight FROM sources
), shares AS (
  SELECT 0 AS step, sum(size)::BIGINT AS rest, sum(weight)::BIGINT AS parts FROM weighed
  UNION ALL
  SELECT step + 1, (sum(size) - coalesce(sum(3 * size) FILTER (weight * rest > 3 * size * parts), 0))::BIGINT, (sum(weight) - coalesce(sum(weight) FILTER (weight * rest > 3 * size * parts), 0))::BIGINT
  FROM shares, weighed WHERE step < 40 GROUP BY step, rest, parts
), share AS (SELECT rest, parts FROM shares WHERE step = 40
), aimed AS (
  SELECT w.*, CASE WHEN weight * rest > 3 * size * parts THEN (3 * size)::DOUBLE ELSE (weight * rest)::DOUBLE / parts END AS target,
    CASE WHEN weight * rest > 3 * size * parts THEN 3 * size ELSE weight * rest // parts END AS aim, (size + 255) // 256 AS blocks, size // 256 AS "full" FROM weighed w, share
), counted AS (SELECT *, CASE WHEN size > 0 THEN (aim // size) * blocks + (aim % size + 255) // 256 ELSE 0 END AS many FROM aimed
), planned AS (SELECT *, (sum(many) OVER (ORDER BY source) - many)::BIGINT AS low FROM counted
), total AS (SELECT greatest(1, sum(many))::BIGINT AS n FROM counted
), numbers AS (SELECT unnest(range((SELECT sum(many)::BIGINT FROM counted))) AS number
), {_fifth("one", f"number % {_P} * 48271 + number // {_P} * 69621 + 11", "h1", "numbers")},
{_fifth("two", f"h1 * 16807 + number % {_P} + 7", "h2", "one")},
points AS (SELECT number, (h1 * {_P} + h2) % n AS point FROM two, total
), drawn AS (SELECT p.number, s.source FROM points p JOIN planned s ON p.point >= s.low AND p.point < s.low + s.many
), ranked AS (SELECT number, source, row_number() OVER (PARTITION BY source ORDER BY number) - 1 AS rank FROM drawn
), balance AS (
  SELECT p.source, p.many, coalesce(d.n, 0) AS drawn, greatest(coalesce(d.n, 0) - p.many, 0) AS over, greatest(p.many - coalesce(d.n, 0), 0) AS under
  FROM planned p LEFT JOIN (SELECT source, count(*) AS n FROM drawn GROUP BY source) d ON p.source = d.source
), placed AS (SELECT *, sum(over) OVER (ORDER BY source) - over AS over_before, sum(under) OVER (ORDER BY source) - under AS under_before FROM balance
), final AS (
  SELECT r.source, r.rank FROM ranked r JOIN placed p ON r.source = p.source WHERE r.rank < p.many
  UNION ALL
  SELECT q.source, (q.drawn + p.over_before + r.rank - p.many - q.under_before)::BIGINT FROM ranked r JOIN placed p ON r.source = p.source AND r.rank >= p.many
  JOIN placed q ON p.over_before + r.rank - p.many >= q.under_before AND p.over_before + r.rank - p.many < q.under_before + q.under
), slots AS (SELECT f.source, p.size, p.aim, p."full", f.rank // p.blocks AS epoch, f.rank % p.blocks AS place FROM final f JOIN planned p ON f.source = p.source
), {_fifth("seeded", "source * 8 + epoch + 3", "seed", "slots")},
inner_ AS (SELECT *, place AS x FROM seeded WHERE place < "full"
), {_permute("inner_", "perm")},
blocked AS (SELECT source, size, aim, epoch, place, x AS block FROM perm{len(_ROUNDS) - 1} UNION ALL SELECT source, size, aim, epoch, place, place FROM seeded WHERE place >= "full"
), filled AS (SELECT source, block, least(256, size - block * 256, aim - epoch * size - place * 256) AS words FROM blocked
), spread AS (
  SELECT s.row, s.doc_id, s.size, n.source, n.size AS source_size, n.target, (sum(s.size) OVER (PARTITION BY n.source ORDER BY s.doc_id NULLS FIRST, s.size, s.row) - s.size)::BIGINT AS start
  FROM sized s JOIN planned n ON s.name IS NOT DISTINCT FROM n.name
), met AS (
  SELECT row, sum(least(start + size, block * 256 + words) - greatest(start, block * 256)) AS taken FROM (
    SELECT row, source, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM spread WHERE size > 0) d
  JOIN filled f USING (source, block) WHERE least(start + size, block * 256 + words) > greatest(start, block * 256) GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM spread LEFT JOIN met ON spread.row = met.row
"""
