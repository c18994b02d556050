"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

SHARDS = """
WITH RECURSIVE k AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS body FROM documents
), step AS (
  SELECT DISTINCT key, -1::BIGINT AS b, 0::BIGINT AS j, 1 AS i FROM k
  UNION ALL
  SELECT key, j, CAST(floor((j + 1) * 4294967296.0::DOUBLE / (('0x' || substr(md5(key || ':' || i), 1, 8))::BIGINT + 1)) AS BIGINT), i + 1
  FROM step WHERE j < 16
), home AS (
  SELECT key, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 16 THEN 16 ELSE b END AS INTEGER) AS grown_shard FROM step WHERE j >= 16
), byte_step AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), sized AS (
  SELECT doc_id, key, octet_length(body) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM k, byte_step
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 8))::BIGINT, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sized JOIN home USING (key)
"""

SUBSTRINGS = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w)
), first AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), cut AS (
  SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (h) WHERE doc_id > lo
), gone AS (SELECT r, count(*) AS n, list(p) AS ps FROM cut GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS s
  FROM d
), e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS t FROM sh
), pairs AS (
  SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM e a JOIN e b ON a.t = b.t AND a.r <> b.r AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL
), links AS (SELECT x, y FROM pairs WHERE 100 * c >= 90 * (nx + ny - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(sh.doc_id) AS m FROM reach JOIN sh ON sh.r = reach.y GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(m, doc_id), doc_id) AS component_id FROM sh LEFT JOIN least ON x = r
"""

MIXTURE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT AS spot
  FROM documents
), src AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 3 AS cap FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][s % 3 + 1] AS weight FROM src
), fill AS (
  SELECT 1 AS i, (SELECT sum(source_size) FROM w) / CAST((SELECT sum(weight) FROM w) AS DOUBLE) AS level
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w WHERE cap <= level * weight), 0))
    / CAST((SELECT sum(weight) FROM w WHERE cap > level * weight) AS DOUBLE) FROM fill WHERE i < (SELECT count(*) FROM w)
), top AS (SELECT level FROM fill ORDER BY i DESC LIMIT 1
), t AS (
  SELECT s, source, source_size, round(CASE WHEN cap <= level * weight THEN cap ELSE level * weight END, 6)::DOUBLE AS target,
    source_size // 1024 AS whole, (source_size + 1023) // 1024 AS each FROM w, top
), q AS (
  SELECT *, CAST(round(target) AS BIGINT) // source_size AS passes, CAST(round(target) AS BIGINT) % source_size AS rest FROM t WHERE source_size > 0
), g AS (
  SELECT *, g // each AS pass, g % each AS j FROM (SELECT *, unnest(range(0, passes * each + (rest + 1023) // 1024)) AS g FROM q)
), slots AS (
  SELECT s, CASE WHEN j < whole THEN ((CASE WHEN whole % 1000003 <> 0 THEN 1000003 ELSE 1000033 END) * j
      + ('0x' || substr(md5('block:' || s || ':' || pass), 1, 8))::BIGINT) % whole ELSE j END AS block,
    least(1024, CASE WHEN pass < passes THEN source_size ELSE rest END - j * 1024) AS take
  FROM g
), placed AS (
  SELECT doc_id, size, s, source_size, target, d.spot, row_number() OVER () AS r,
    coalesce(sum(size) OVER (PARTITION BY s ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT r, s, start, size, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT r, sum(greatest(0, least(block * 1024 + take, start + size) - greatest(block * 1024, start))) AS n FROM pieces JOIN slots USING (s, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (r)
"""

LINES = r"""
WITH l AS (
  SELECT r, doc_id, pos, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, line
  FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (
    SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), u AS (
  SELECT row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := pos))) AS k, ws, len(ws) AS n FROM l WHERE len(ws) > 0 GROUP BY ws
), v AS (
  SELECT k, n, n AS longer, p, hash(list_concat(ws[1 : p], ws[p + 2 : n])) AS h FROM (SELECT *, unnest(range(0, n)) AS p FROM u WHERE n >= 8)
  UNION ALL SELECT k, n, n + 1, p, hash(ws) FROM (SELECT *, unnest(range(0, n + 1)) AS p FROM u WHERE n >= 8)
), near AS (SELECT DISTINCT v.k FROM v JOIN (SELECT longer, p, h, min(k) AS hub FROM v GROUP BY ALL) USING (longer, p, h) WHERE hub < v.k
), firsts AS (SELECT ws, k, k IN (SELECT k FROM near) AS near FROM u
), marked AS (
  SELECT l.*, len(l.ws) > 0 AND (coalesce(near, false) OR row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1) AS gone FROM l LEFT JOIN firsts USING (ws)
), texts AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, texts.text FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN texts USING (r)
"""

_BYTE_STEP = """byte_step AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text beside ``byte_step``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


TRIE = rf"""
WITH {_BYTE_STEP}, turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k,
    struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(turn ORDER BY k) AS ts, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM turns, byte_step GROUP BY conv_id, t
), seqs AS (
  SELECT own.conv_id, list_concat(coalesce(base.ts[1 : own.h], []), own.ts[own.h + 1 :]) AS ts
  FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 20
), members AS (
  SELECT conv_id, d, len(ts) AS n_turns, md5(CAST(to_json(ts[1 : d]) AS VARCHAR)) AS name,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(ts[d].x, '[^ 	-
]+')) END AS words
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT d, name, min(conv_id) AS rep, count(*) AS n, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = d), '')) AS ends
  FROM members GROUP BY d, name
), up AS (
  SELECT v.d, v.name, p.rep AS parent, p.name AS above FROM nodes v JOIN members m ON m.conv_id = v.rep AND m.d = v.d - 1 JOIN nodes p ON p.d = m.d AND p.name = m.name
), kids AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM up GROUP BY ALL
), sums AS (
  SELECT m.d, m.name, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.words) AS saved
  FROM nodes u LEFT JOIN kids k USING (d, name) JOIN members m ON m.conv_id = u.rep AND m.d <= u.d GROUP BY ALL
)
SELECT rep AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes LEFT JOIN up USING (d, name) LEFT JOIN kids USING (d, name) JOIN sums USING (d, name)
"""


def _put(value: str, cost: str, initial: str) -> str:
    """A cost in 12 digits and an audit, with an edit put before it; '~' is out of reach."""
    return f"CASE WHEN {value} = '~' THEN '~' ELSE printf('%012d', CAST({value}[1:12] AS BIGINT) + {cost}) || '{initial}' || {value}[13:] END"


def _kept(state: int) -> str:
    """Least of deleting, keeping and rewriting the row in a state, before insertions."""
    legal, to = {0: ("'s', 'u'", "CASE WHEN i = 's' THEN v1 ELSE v2 END"), 1: ("'u'", "v2"), 2: ("'a'", "v3"), 3: ("'u'", "v2")}[state]
    keep = f"CASE WHEN i IN ({legal}) AND NOT must_go THEN {_put(f'({to})', 'more', 'K')} ELSE '~' END"
    rerole = f"CASE WHEN NOT must_go THEN {_put('v3' if state == 2 else 'v2', 'more + 1', 'R')} ELSE '~' END"
    return f"least({_put(f'v{state}', '2', 'D')}, {keep}, {rerole})"


REPAIR = rf"""
WITH RECURSIVE {_BYTE_STEP}, hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, byte_step
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE fault <> 0
), placed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k,
    NOT regexp_matches(text, '[^ 	-
]') AS blank FROM hurt
), marked AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 AS again FROM placed
), seen AS (
  SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY k) AS j FROM marked
), counts AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (j IS NOT NULL AND j || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM seen GROUP BY g
), step AS (
  SELECT g, n + 1 AS k, printf('%012d', 0) AS v0, printf('%012d', 10) || 'II' AS v1, printf('%012d', 5) || 'I' AS v2, printf('%012d', 0) AS v3 FROM counts
  UNION ALL
  SELECT g, k, least(b0, {_put("w2", "5", "I")}), least(b1, {_put("w2", "5", "I")}), w2, w3 FROM (
    SELECT *, least(b2, {_put("b3", "5", "I")}) AS w2, least(b3, {_put("b2", "5", "I")}) AS w3 FROM (
      SELECT g, k, {", ".join(f"{_kept(q)} AS b{q}" for q in range(4))} FROM (
        SELECT s.g, s.k - 1 AS k, v0, v1, v2, v3, i, blank OR again AS must_go, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM step s JOIN seen r ON r.g = s.g AND r.k = s.k - 1)))
), best AS (SELECT g, CAST(v0[1:12] AS BIGINT) AS cost, v0[13:] AS audit FROM step WHERE k = 1
), letters AS (SELECT g, pos, audit[pos] AS ch FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)
), rows_of AS (SELECT g, pos, ch, sum(CASE WHEN ch = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY pos) AS k FROM letters
), outs AS (
  SELECT o.g, o.pos, ch, role, text, row_number() OVER w AS nth, first_value(ch = 'K' AND left(role, 1) = 's') OVER w AS led
  FROM rows_of o LEFT JOIN seen r ON r.g = o.g AND r.k = o.k AND ch <> 'I' WHERE ch <> 'D' WINDOW w AS (PARTITION BY o.g ORDER BY o.pos)
), texts AS (
  SELECT g, string_agg(CASE WHEN ch = 'K' THEN role WHEN (nth - CASE WHEN led THEN 2 ELSE 1 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN ch = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body
  FROM outs GROUP BY g
), found AS (SELECT counts.*, cost, audit, body FROM counts JOIN best USING (g) LEFT JOIN texts USING (g)
)
SELECT o.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
