r"""The queries that SQL can state, in DuckDB's SQL over the same tables."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def lower(c: str) -> str:
    return f"translate({c}, {UPPER}, {LOWER})"


def words_of(table: str, key: str, text: str, pattern: str) -> str:
    """Rows (key, i from 1, w) of a table's words."""
    return f"SELECT {key}, unnest(regexp_extract_all({text}, {pattern})) AS w, generate_subscripts(regexp_extract_all({text}, {pattern}), 1) AS i FROM {table}"


def op2(limit: int) -> str:
    return f"""
WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, ''))), 1, 15))::BIGINT AS h FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY h) - 1 AS copy, sum(n_bytes) OVER (PARTITION BY h) AS all_bytes FROM h),
  p AS (SELECT *, h >> (60 - d) AS prefix FROM r, (SELECT unnest(range(61)) AS d)),
  b AS (SELECT d, prefix, sum(n_bytes) <= {limit} OR count(DISTINCT h) = 1 AS fits FROM p GROUP BY 1, 2),
  f AS (SELECT doc_id, n_bytes, h, copy, all_bytes, min(p.d) AS shard_depth FROM p JOIN b USING (d, prefix) WHERE fits GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, n_bytes, shard_depth::BIGINT AS shard_depth, h >> (60 - shard_depth) AS shard_prefix,
  CASE WHEN all_bytes <= {limit} THEN 0 ELSE copy // greatest({limit} // greatest(n_bytes, 1), 1) END::BIGINT AS shard_part FROM f"""


def op3(min_docs: int, max_share: int, max_docs: int, min_left: int) -> str:
    norm = f"array_to_string(regexp_extract_all(regexp_replace({lower('line')}, '[0-9]', '0', 'g'), {WORD}), ' ')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
  w AS (SELECT doc_id, t, regexp_extract_all(t, {WORD}) AS ws FROM d),
  base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
  l0 AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
  l AS (SELECT doc_id, source, line, {norm} AS norm, len(regexp_extract_all(line, {WORD})) AS n FROM l0 WHERE regexp_matches(line, {WORD})),
  dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l GROUP BY 1),
  held AS (SELECT source, norm, count(DISTINCT doc_id) AS c FROM l GROUP BY 1, 2),
  hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
  above AS (SELECT held.source, norm FROM held JOIN hosts USING (source) WHERE c > {min_docs} AND (c * 100 > docs * {max_share} OR c > {max_docs})),
  gone AS (SELECT doc_id, sum(n)::BIGINT AS n_removed_words FROM l JOIN above USING (source, norm) GROUP BY 1),
  pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
  g AS (SELECT doc_id, i, w, lead(w) OVER a AS w2, lead(w, 2) OVER a AS w3 FROM pos WINDOW a AS (PARTITION BY doc_id ORDER BY i)),
  k AS (SELECT doc_id, i, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1)::INT AS hot FROM g),
  c AS (SELECT doc_id, max(hot) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM k),
  rep AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM c GROUP BY 1),
  m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= {min_left} * n_words AS kept FROM m"""


def op5(size: int = 13) -> str:
    return f"""
WITH bw AS (SELECT item_id, regexp_extract_all({lower('text')}, {ALNUM}) AS ws FROM benchmark),
  win AS (SELECT DISTINCT item_id, least({size}, len(ws)) AS k, array_to_string(ws[s:s + least({size}, len(ws)) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {size}, 0) + 2)) AS s FROM bw WHERE len(ws) > 0)),
  dw AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {ALNUM}) AS ws FROM documents),
  dg AS (SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
  occ AS (SELECT doc_id, s, dg.k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
  hit AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS i FROM occ) GROUP BY 1),
  items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op7() -> str:
    """Trigrams, none pruned; millionths of log10 as whole numbers."""
    log = lambda x: f"floor(log10({x}::DOUBLE) * 1000000 + 0.5)::BIGINT"
    return f"""
WITH pos AS ({words_of('documents', 'doc_id', lower("coalesce(text, '')"), WORD)}),
  g AS (SELECT doc_id, lag(w, 2) OVER o AS a, lag(w) OVER o AS b, w AS c FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  u AS (SELECT c, count(*) AS n FROM g GROUP BY 1), t AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2), v AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM g),
  s AS (SELECT doc_id, CASE WHEN v.n IS NOT NULL THEN {log('v.n')} - {log('tab.n')} WHEN t.n IS NOT NULL THEN {log('t.n')} - {log('ub.n')} ELSE {log('uc.n')} - {log('n.n')} END AS s
    FROM g CROSS JOIN n JOIN u uc ON uc.c = g.c LEFT JOIN u ub ON ub.c = g.b LEFT JOIN t ON t.b = g.b AND t.c = g.c LEFT JOIN t tab ON tab.b = g.a AND tab.c = g.b LEFT JOIN v ON v.a = g.a AND v.b = g.b AND v.c = g.c),
  x AS (SELECT doc_id, count(*) AS n_words, sum(s)::BIGINT AS score_micro FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(score_micro, 0) AS score_micro, coalesce(score_micro::DOUBLE / 1000000 / n_words, 0) AS score FROM documents LEFT JOIN x USING (doc_id)"""


def op8(size: int = 50) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
  g AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + {size - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size} + 2)) AS s FROM d WHERE len(ws) >= {size})),
  f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {size})) AS i FROM g JOIN f USING (h) WHERE first < doc_id),
  w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
  k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op9(k: int = 4, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {WORD}) AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {k - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k}, 0) + 2)) AS i FROM d WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
  way AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, way.b FROM r JOIN way ON way.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.lowest, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS lowest FROM r GROUP BY 1) c ON c.doc_id = d.doc_id"""


def op10(budget: int, history: int) -> str:
    escape = "replace(replace(replace({}, chr(92), chr(92) || 'b'), '#', chr(92) || 'h'), '<', chr(92) || 'l')"
    extra = "chr(92) || '### Assistant: </turn> ok'"
    return f"""
WITH RECURSIVE t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {extra} UNION ALL SELECT -7, 1, 'assistant', {extra}),
  t AS (SELECT *, row_number() OVER o AS i, len(regexp_extract_all(text, '[^ \\t-\\r]+'))::BIGINT AS tok, 4 + length({escape.format('role')}) + 1 + length({escape.format('text')}) + 8 AS size FROM t0 WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
  p AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) - tok AS before, sum(size) OVER (PARTITION BY conv_id ORDER BY i) - size AS at FROM t),
  c AS (SELECT conv_id, count(*) AS n, max((i = 1 AND role = 'system')::INT) AS lead, max(CASE WHEN i = 1 AND role = 'system' THEN tok ELSE 0 END) AS head, max(CASE WHEN i = 1 AND role = 'system' THEN size ELSE 0 END) AS head_size FROM p GROUP BY 1),
  w AS (SELECT conv_id, 1 AS i, 0 AS first, 0 AS past, 0::BIGINT AS again FROM c
    UNION ALL SELECT w.conv_id, w.i + 1, CASE WHEN z.over THEN w.i ELSE w.first END, CASE WHEN z.over THEN z.past ELSE w.past END, w.again + CASE WHEN z.over THEN z.again ELSE 0 END
    FROM w JOIN c USING (conv_id) JOIN (SELECT x.conv_id, x.i, f.first, f.past AS was, x.i - 1 > greatest(f.first, c.lead) AND CASE WHEN f.past > 0 THEN c.head ELSE 0 END + x.before + x.tok - q.before > {budget} AS over,
        least(x.i - 1, greatest(c.lead, (SELECT count(*) FROM p y WHERE y.conv_id = x.conv_id AND y.before < greatest(x.before - {history}, c.head + x.before + x.tok - {budget})))) AS past,
        c.head_size + x.at - (SELECT max(y.at) FROM p y WHERE y.conv_id = x.conv_id AND y.i = 1 + least(x.i - 1, greatest(c.lead, (SELECT count(*) FROM p v WHERE v.conv_id = x.conv_id AND v.before < greatest(x.before - {history}, c.head + x.before + x.tok - {budget}))))) AS again
        FROM p x JOIN c ON c.conv_id = x.conv_id JOIN p q ON q.conv_id = x.conv_id JOIN (SELECT DISTINCT conv_id, i - 1 AS first, j - 1 AS past FROM (SELECT a.conv_id, a.i, b.i AS j FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.i <= a.i)) f ON f.conv_id = x.conv_id AND q.i = f.past + 1 AND f.first < x.i) z
      ON z.conv_id = w.conv_id AND z.i = w.i + 1 AND z.first = w.first AND z.was = w.past WHERE w.i < c.n),
  f AS (SELECT conv_id, max(again) AS again FROM w GROUP BY 1)
SELECT p.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(size) + max(again))::BIGINT AS formatted_chars FROM p JOIN f USING (conv_id) GROUP BY 1"""


def op12(templates: list[tuple[str, str, list[int], bool]]) -> str:
    """templates: label, words, places of the key words, whether it is a base phrase."""
    rows = ", ".join(f"({i}, '{label}', {base}, {q}, '{w}', {q in keys})" for i, (label, words, keys, base) in enumerate(templates) for q, w in enumerate(words.split()))
    return f"""
WITH t(k, label, base, q, w, key) AS (VALUES {rows}),
  d AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {ALNUM}) AS ws FROM documents),
  p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
  v AS (SELECT w, count(DISTINCT doc_id) AS held FROM p WHERE w IN (SELECT w FROM t) GROUP BY 1),
  f AS (SELECT w, greatest(1, floor(log10(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(held, 0) + 1)) * 1000000 + 0.5))::BIGINT AS idf FROM (SELECT DISTINCT w FROM t) LEFT JOIN v USING (w)),
  n AS (SELECT k, sum(idf)::BIGINT AS whole, count(*) FILTER (key) AS keys FROM t JOIN f USING (w) GROUP BY 1),
  m AS (SELECT doc_id, k, label, base, i - q AS s, sum(idf)::BIGINT AS own, count(*) FILTER (key) AS keys FROM p JOIN t USING (w) JOIN f USING (w) GROUP BY ALL),
  x AS (SELECT m.*, own * 1000000 // whole AS score FROM m JOIN n USING (k) WHERE m.keys = n.keys),
  g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, max(score) AS score,
      array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM x GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE / 1000000 AS score
FROM d LEFT JOIN g USING (doc_id)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {eight}), 4294967295)"


TURN = "md5(concat_ws(':', length(role)::VARCHAR, role, text))"


def op11() -> str:
    return f"""
WITH t AS (SELECT conv_id AS c, turn, octet_length(encode(text)) AS size, {TURN} AS d FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
  n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM t),
  v AS (SELECT c, c - c % 5 AS b, {crc32('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
  r AS (SELECT v.c, 0 AS part, i, size, d FROM v JOIN n ON n.c = v.b AND i <= h UNION ALL SELECT v.c, 1, i, size, d FROM v JOIN n ON n.c = v.c AND i > h),
  p AS (SELECT c, row_number() OVER o AS depth, size, list(d) OVER o AS path FROM r WINDOW o AS (PARTITION BY c ORDER BY part, i)),
  m AS (SELECT c, depth, size, path, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p UNION ALL SELECT c, 0, 0, []::VARCHAR[], c NOT IN (SELECT c FROM p) FROM v),
  k AS (SELECT path, depth, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY 1, 2),
  kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1),
  w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN kids USING (path)),
  s AS (SELECT path[:a] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM w, unnest(range(depth + 1)) AS x(a) GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN k up ON w.depth > 0 AND up.path = w.path[:-2]"""


def op13() -> str:
    """Cheapest repairs forwards, row by row: for each state (e: start, s, u, a) cost, letters and turns."""

    def then(x: str, cost: str, letter: str, line: str) -> str:
        line = f" || chr(10) || {line}" if line else ""
        return f"CASE WHEN {x} IS NOT NULL THEN struct_pack(c := {x}.c + {cost}, l := {x}.l || '{letter}', t := {x}.t{line}) END"

    drop, insert = (lambda x: then(x, "2", "D", "")), (lambda x, role: then(x, "5", "I", f"'{role}:'"))
    keep = lambda x, initial: f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN {then(x, 'extra', 'K', 'line')} END"
    change = lambda x, role: f"CASE WHEN fault NOT IN (1, 2) THEN {then(x, '1 + extra', 'R', repr(role + ':') + ' || text')} END"
    blank = r"'[^\x20\x09-\x0D]'"
    return f"""
WITH RECURSIVE g AS (SELECT *, {crc32("concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' '))")} % 20 AS g FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations)),
  r AS (SELECT conv_id, turn, CASE WHEN g = 4 THEN 'user' ELSE role END AS role, CASE WHEN g = 1 THEN '' WHEN g = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN g = 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE g <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN}, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, substr(role, 1, 1) AS initial, role || ':' || text AS line FROM r),
  f AS (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM (SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o)),
  n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
  z AS (SELECT conv_id, 0::BIGINT AS i, e, s, u, a FROM (SELECT conv_id, e, NULL::STRUCT(c BIGINT, l VARCHAR, t VARCHAR) AS s, {insert('e', 'user')} AS u, {then('e', '10', 'II', "'user:' || chr(10) || 'assistant:'")} AS a
      FROM (SELECT conv_id, struct_pack(c := 0::BIGINT, l := '', t := '') AS e FROM n))
    UNION ALL SELECT conv_id, i, e, s, u1, least(a, {insert('u1', 'assistant')}) FROM (SELECT *, least(u, {insert('e', 'user')}, {insert('s', 'user')}, {insert('a', 'user')}) AS u1
      FROM (SELECT z.conv_id, f.i, {drop('z.e')} AS e, least({drop('z.s')}, {keep('z.e', 's')}) AS s,
        least({drop('z.u')}, {', '.join(x for q in 'esa' for x in (keep(f'z.{q}', 'u'), change(f'z.{q}', 'user')))}) AS u, least({drop('z.a')}, {keep('z.u', 'a')}, {change('z.u', 'assistant')}) AS a
        FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i + 1))),
  w AS (SELECT z.conv_id, least(e, a) AS best FROM z JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = n.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""
