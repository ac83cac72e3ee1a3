"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 75 * (x.n + y.n - i.k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

SUFFIX_ARRAY = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS p, h FROM d WHERE len(h) >= 200),
s AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM w),
c AS (SELECT doc_id, p FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM r UNION ALL SELECT doc_id, max(hi), NULL FROM r GROUP BY ALL),
t AS (SELECT k.doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY ALL),
z AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS runs FROM r GROUP BY ALL)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_TREE = """list_transform(string_split({x}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(
  CASE WHEN regexp_matches(p, '[!-/:-@\\[-`{{-~][ \\t\\n\\x0b\\f\\r]$') OR p = '' THEN list_append(regexp_extract_all(p, '(?s)(?:.*?[!-/:-@\\[-`{{-~][ \\t\\n\\x0b\\f\\r])|(?s).+$'), '')
   ELSE regexp_extract_all(p, '(?s)(?:.*?[!-/:-@\\[-`{{-~][ \\t\\n\\x0b\\f\\r])|(?s).+$') END, lambda c: sha256(c))))"""
_SECTIONS = "list_transform({t}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), '')))"
_PRINT = """concat_ws(':', sha256(array_to_string({s}, '')), array_to_string(list_transform({t}, lambda x, i: concat({s}[i][:16], '=',
  array_to_string(list_transform(x, lambda p: array_to_string(list_transform(p, lambda y: y[:10]), '.')), ','))), '/'))"""
_LEAVES = "list_distinct(regexp_split_to_array(regexp_replace(split_part({f}, ':', 2), '[0-9a-f]+=', '', 'g'), '[./,]'))"
_NEAR = "CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0 ELSE least(len(list_intersect({x}, {y})) * 2.0 / (len({x}) + len({y})), 0.999999) END::DOUBLE"


def _level(name: str, source: str, keys: str, split: str) -> str:
    """One level of the tree: the differing places of the rows of `source`, which carry lists x and y and the path so far."""
    same = lambda x, y: f"coalesce(nullif(list_position(list_transform(list_zip({x}, {y}), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1, least(len(x), len(y)))"
    return f"""{name}k AS (SELECT doc_id, path, x, y, {keys.format(v="x")} AS kx, {keys.format(v="y")} AS ky FROM {source}),
{name}t AS (SELECT *, {same("kx", "ky")} AS pre, {same("list_reverse(kx)", "list_reverse(ky)")} AS tail FROM {name}k),
{name}p AS (SELECT doc_id, path, x, y, unnest(CASE WHEN len(kx) = len(ky) THEN list_transform(list_filter(range(len(kx)), lambda i: kx[i + 1] <> ky[i + 1]), lambda i: {{'at': i, 'n': 1, 'm': 1}})
  ELSE [{{'at': pre, 'n': len(x) - pre - least(tail, least(len(x), len(y)) - pre), 'm': len(y) - pre - least(tail, least(len(x), len(y)) - pre)}}] END) AS e FROM {name}t),
{name} AS (SELECT doc_id, path || [e.at] AS path, e.n AS n, e.m AS m, {split.format(v="x[e.at + 1]")} AS x, {split.format(v="y[e.at + 1]")} AS y FROM {name}p)"""


def _near(a: str, b: str) -> str:
    return _NEAR.format(a=a, b=b, x=_LEAVES.format(f=a), y=_LEAVES.format(f=b))


_SECTION = "list_transform({v}, lambda z: split_part(z, '=', 1))"

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, {_TREE.format(x="text")} AS t FROM d),
f AS (SELECT doc_id, text, {_PRINT.format(t="t", s=_SECTIONS.format(t="t"))} AS f FROM t),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt, coalesce(lead(f) OVER w, first_value(f) OVER w) AS nf FROM f WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, concat(left(text, length(text) - length(text) // 2), left(nt, length(text) // 2)) AS e FROM n),
u AS (SELECT *, {_TREE.format(x="e")} AS t FROM e),
v AS (SELECT *, {_PRINT.format(t="t", s=_SECTIONS.format(t="t"))} AS g FROM u),
l0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, string_split(split_part(f, ':', 2), '/') AS x, string_split(split_part(g, ':', 2), '/') AS y FROM v),
{_level("l1", "l0", _SECTION, "string_split(split_part({v}, '=', 2), ',')")},
{_level("l2", "(SELECT * FROM l1 WHERE n = 1 AND m = 1)", "{v}", "string_split({v}, '.')")},
{_level("l3", "(SELECT * FROM l2 WHERE n = 1 AND m = 1)", "{v}", "{v}")},
w AS (SELECT doc_id, path, n, m FROM l1 WHERE n <> 1 OR m <> 1 UNION ALL SELECT doc_id, path, n, m FROM l2 WHERE n <> 1 OR m <> 1 UNION ALL SELECT doc_id, path, n, m FROM l3),
z AS (SELECT doc_id, string_agg(concat(array_to_string(path, '.'), ':', n, ':', m), ' ' ORDER BY path) AS edits FROM w GROUP BY ALL)
SELECT doc_id, length(text) AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint, {_near("f", "g")} AS near_edited, {_near("f", "nf")} AS near_next, coalesce(edits, '') AS edits FROM v LEFT JOIN z USING (doc_id)
"""


def chat(messages: str) -> str:
    """SQL of the linked conversations over a table expression with conv_id, turn, role and text."""
    normal = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    return f"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM {messages}),
q AS (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'line': i, 'raw': x}}), recursive := true) FROM b WHERE text IS NOT NULL),
l AS (SELECT id, line, length(regexp_replace(regexp_extract(raw, '^((?:\\s*>)*)', 1), '[^>]', '', 'g')) AS lv, regexp_replace(raw, '^(?:\\s*>)+ ?', '') AS words FROM q),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY line) AS passage FROM (SELECT *, CASE WHEN lag(lv) OVER (PARTITION BY id ORDER BY line) = lv THEN 0 ELSE 1 END AS new FROM l)),
has AS (SELECT id FROM g GROUP BY id HAVING max(lv) > 0),
p AS (SELECT id, passage, lv, string_agg(words, chr(10) ORDER BY line) AS words, min(line) AS line FROM g GROUP BY ALL),
o AS (SELECT b.id, CASE WHEN b.id IN (FROM has) THEN coalesce(x.own, '') ELSE b.text END AS own_text FROM b LEFT JOIN (SELECT id, string_agg(words, chr(10) ORDER BY line) AS own FROM g WHERE lv = 0 GROUP BY id) x USING (id)),
said AS (SELECT id, words FROM g WHERE lv = 0 UNION ALL SELECT id, words FROM p WHERE lv = 0),
idx AS (SELECT conv_id, {normal("words")} AS h, min(turn) AS original FROM said JOIN b USING (id) WHERE {normal("words")} <> '' GROUP BY ALL),
asked AS (SELECT id, passage, lv, 0 AS rk, line, {normal("words")} AS h FROM p WHERE lv > 0 UNION ALL SELECT id, passage, lv, 1, line, {normal("words")} FROM g WHERE lv > 0),
met AS (SELECT a.*, CASE WHEN i.original < b.turn THEN i.original END AS original FROM asked a JOIN b USING (id) LEFT JOIN idx i ON i.conv_id IS NOT DISTINCT FROM b.conv_id AND i.h = a.h WHERE a.h <> ''),
one AS (SELECT id, passage, lv, min(line) AS line, arg_min(original, (rk, line)) FILTER (original IS NOT NULL) AS original FROM met GROUP BY ALL),
r AS (SELECT id, count(*) AS n_quotes, count(original) AS n_linked, arg_min(original, (lv, line)) FILTER (original IS NOT NULL) AS reply_to FROM one GROUP BY id),
k AS (SELECT conv_id, turn, min(reply_to) AS up FROM r JOIN b USING (id) WHERE reply_to IS NOT NULL GROUP BY ALL),
f AS (SELECT conv_id, turn, up AS root, 1 AS depth FROM k UNION ALL SELECT f.conv_id, f.turn, k.up, f.depth + 1 FROM f JOIN k ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND k.turn = f.root),
t AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM f GROUP BY ALL),
z AS (SELECT b.conv_id, b.turn, role, text, own_text, reply_to, CASE WHEN b.id IN (FROM has) THEN coalesce(root, b.turn) ELSE b.turn END AS root_turn, CASE WHEN b.id IN (FROM has) THEN coalesce(t.depth, 0) ELSE 0 END AS depth,
  coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked FROM b JOIN o USING (id) LEFT JOIN r USING (id) LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.turn = b.turn)
SELECT conv_id, turn, role, own_text, reply_to, root_turn, depth::BIGINT AS depth, n_quotes::BIGINT AS n_quotes, n_linked::BIGINT AS n_linked,
 row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM z
"""


#: Conversations in which from the third turn on messages quote earlier ones: the whole turn before, or two turns before it one level
#: deeper, or, with more blanks, the first line of the first turn. The same text serves Spark and DuckDB.
QUOTING = """
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.turn < 2 OR p.text IS NULL THEN m.text
  WHEN m.turn % 3 = 2 THEN concat('> ', replace(p.text, chr(10), concat(chr(10), '> ')), chr(10), m.text)
  WHEN m.turn % 3 = 0 AND o.text IS NOT NULL THEN concat('>> ', replace(o.text, chr(10), concat(chr(10), '>> ')), chr(10), '> ', replace(p.text, chr(10), concat(chr(10), '> ')), chr(10), m.text)
  ELSE concat(m.text, chr(10), '> ', replace(split_part(f.text, chr(10), 1), ' ', '  '), chr(10), 'So be it.') END AS text
FROM {conversations} m LEFT JOIN {conversations} p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1
LEFT JOIN {conversations} o ON o.conv_id = m.conv_id AND o.turn = m.turn - 2 LEFT JOIN {conversations} f ON f.conv_id = m.conv_id AND f.turn = 0
"""

#: Targets by filling a common level: sources in the order of their caps over their weights.
MIX_TARGETS = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
a AS (SELECT *, 2 * source_size / w AS x, 1.5 * sum(source_size) OVER () AS total FROM s),
b AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY x, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY x, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM a),
c AS (SELECT arg_min((total - held) / open, x) FILTER ((total - held) / open <= x) AS level FROM b)
SELECT doc_id, size, source_size, coalesce(round(least(2.0 * source_size, w * level), 3), 2.0 * source_size)::DOUBLE AS target FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source, c
"""

#: The 256 remainders of the reflected polynomial of CRC-32, from its rule, and the CRC of a string's UTF-8 bytes.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"


def _crc32(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Words q apart that are equal, in stretches; of the periods of one stretch the smallest.
PERIODIC_RUNS = f"""
WITH z AS ({_CRC_TABLE}),
d AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, {_WORDS} AS w0 FROM documents, z),
a AS (SELECT *, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
o AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM e),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM g GROUP BY doc_id, q, g HAVING count(*) >= greatest(12 - q, q)),
r AS (SELECT doc_id, s, m, min(q) AS q FROM s GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'm': m, 'q': q}}, (-m, s, q)) AS best, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS said FROM r GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM o ANTI JOIN x USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.m::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.m // best.q)::BIGINT AS exponent_milli,
 sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Near words by what they are without one place: equal there (a replacement), or one the whole of the other (an insertion).
SPELLING_VARIANTS = f"""
WITH RECURSIVE z AS ({_CRC_TABLE}),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
l AS (SELECT doc_id, translate(w, '{_UPPER}', '{_LOWER}') AS w, count(*) AS n FROM t WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, n, {_crc32("concat(doc_id, ':', w)")} AS h FROM l, z),
s AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(w, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY ALL HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
k AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS k FROM i),
m AS (SELECT x.word, y.word AS other, y.n FROM k x JOIN k y ON x.i = y.i AND x.k = y.k AND x.word <> y.word
 UNION SELECT x.word, v.word, v.n FROM k x JOIN v ON v.word = x.k UNION SELECT v.word, x.word, x.n FROM k x JOIN v ON v.word = x.k),
b AS (SELECT word, count(*) AS n_near, arg_min({{'form': other, 'n': n}}, (-n, encode(other))) AS best FROM m GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN best.form END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(root, depth) FROM r WHERE r.word = f.word), word) AS root, n, n_near, form_n FROM f
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM d WINDOW w AS (PARTITION BY text)
"""
