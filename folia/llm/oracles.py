"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: The weights 5, 2, 1 repeat over the sources by code point; a document's draw weight is the bit length of its size.
OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
classes AS (SELECT source, length(bin(size)) AS draw, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY 1, 2),
sizes AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM classes GROUP BY 1),
ranked AS (
  SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER o - 1) % 3 + 1 AS INT)) AS w, row_number() OVER o AS pos, source_size * 3 AS cap
  FROM sizes WINDOW o AS (ORDER BY source COLLATE "C" ASC NULLS LAST)),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level, row_number() OVER r AS k
  FROM ranked WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, pos)),
level AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM level) * w, CAST(cap AS DOUBLE))) AS target FROM ranked),
scaled AS (
  SELECT c.*, t.target, (t.target - CAST(coalesce(sum(c.words) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS DOUBLE))
    / CAST(sum(c.draw * c.words) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS scale
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WHERE c.words > 0 WINDOW d AS (PARTITION BY c.source ORDER BY c.draw DESC)),
fitted AS (
  SELECT *, coalesce(first_value(CASE WHEN scale * draw <= 3 THEN scale END IGNORE NULLS) OVER d, last_value(scale) OVER d) AS c
  FROM scaled WINDOW d AS (PARTITION BY source ORDER BY draw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
scales AS (SELECT *, greatest(0.0::DOUBLE, least(3.0::DOUBLE, c * draw)) AS e FROM fitted),
rest AS (SELECT source, any_value(target) - CAST(sum(CAST(floor(e) AS BIGINT) * words) AS DOUBLE) AS left_ FROM scales GROUP BY 1),
drawn AS (
  SELECT s.doc_id, s.source, s.size, coalesce(CAST(floor(k.e) AS BIGINT), 0) AS sure, coalesce(k.e - floor(k.e), 0.0::DOUBLE) AS p,
    (CAST(CAST('0x' || substr(md5('folia-mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s LEFT JOIN scales k ON s.source IS NOT DISTINCT FROM k.source AND length(bin(s.size)) = k.draw),
v AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS v FROM drawn),
upto AS (
  SELECT v.*, r.left_, CASE WHEN p > 0 THEN sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY v.source ORDER BY v NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
  FROM v LEFT JOIN rest r ON v.source IS NOT DISTINCT FROM r.source),
gaps AS (SELECT source, any_value(left_) - coalesce(max(CASE WHEN upto <= left_ THEN upto END), 0) AS gap FROM upto WHERE p > 0 GROUP BY 1),
fills AS (
  SELECT u.source, arg_min(u.doc_id, (abs(u.size - g.gap), u.v, u.doc_id)) AS fill
  FROM upto u JOIN gaps g ON u.source IS NOT DISTINCT FROM g.source WHERE u.p > 0 AND u.upto > u.left_ AND abs(u.size - g.gap) < g.gap GROUP BY 1)
SELECT u.doc_id, u.source, u.size, t.source_size, t.target,
  u.sure + CASE WHEN u.p > 0 AND (u.upto <= u.left_ OR u.doc_id = f.fill) THEN 1 ELSE 0 END AS copies,
  (u.sure + CASE WHEN u.p > 0 AND (u.upto <= u.left_ OR u.doc_id = f.fill) THEN 1 ELSE 0 END) * u.size AS taken
FROM upto u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN fills f ON u.source IS NOT DISTINCT FROM f.source
"""

OP9 = """
WITH texts AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""


def _op6() -> str:
    from folia.llm.licences import HINT, STEPS, known

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = "lower(u.unit)"
    for pattern, put in STEPS:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(put.replace('$', chr(92)))}, 'g')"
    table = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known().items()))
    return f"""
WITH known(digest, licence) AS (VALUES {table}),
texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT id, 'text' AS kind, text AS unit FROM texts WHERE regexp_matches(text, {quoted(HINT)})
  UNION ALL SELECT id, 'part', unnest(list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: regexp_matches(x, {quoted(HINT)}))) FROM texts
  UNION ALL SELECT id, 'part', unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted(HINT)}))) FROM texts),
found AS (SELECT u.id, u.kind, k.licence FROM units u JOIN known k ON sha256({form}) = k.digest)
SELECT t.doc_id, max(CASE WHEN kind = 'text' THEN licence END) AS licence,
  coalesce(string_agg(DISTINCT CASE WHEN kind <> 'text' THEN licence END, ',' ORDER BY CASE WHEN kind <> 'text' THEN licence END), '') AS notices,
  count(CASE WHEN kind <> 'text' THEN licence END) AS n_units
FROM texts t LEFT JOIN found f ON t.id = f.id GROUP BY t.id, t.doc_id
"""


#: All pairs of documents that share a shingle, then the closure of the links.
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

ORACLES = {"op1_mix_sources": OP1, "op6_licence_digests": _op6(), "op7_ngram_jaccard_join": OP7, "op9_exact_dedup": OP9}
