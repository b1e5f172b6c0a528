"""DuckDB SQL for the queries that SQL can express, written plainly and apart from the operators' methods."""

from __future__ import annotations

from . import decontaminate as dec
from . import licences as lic
from . import urlfilter as url

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licences() -> str:
    def lit(ws) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    places = ",\n".join(
        f"CASE WHEN contains(line, ' {' '.join(t.key)} ') THEN list_filter(range(0, len(w) - {t.key_size} + 1), lambda i: w[i + 1] = '{t.key[0]}' AND w[i + 1 : i + {t.key_size}] = {lit(t.key)}) ELSE []::BIGINT[] END AS p{k}" for k, t in enumerate(lic.TEMPLATES)
    )
    shares = []
    for k, t in enumerate(lic.TEMPLATES):
        if t.key_size == len(t.words):
            shares.append(f"CASE WHEN len(p{k}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS s{k}")
            continue
        hits = f"list_sum(list_transform(range({len(t.words)}), lambda i: CASE WHEN s - {t.key_at} + i >= 0 AND w[s - {t.key_at} + i + 1] = {lit(t.words)}[i + 1] THEN 1 ELSE 0 END))"
        shares.append(f"coalesce(list_max(list_transform(p{k}, lambda s: {hits}::DOUBLE / {len(t.words)}.0)), 0.0)::DOUBLE AS s{k}")
    n = range(len(lic.TEMPLATES))
    base = [k for k in n if lic.TEMPLATES[k].base]

    def labels(of) -> str:
        own = ", ".join(f"CASE WHEN s{k} >= {lic.LEAST} THEN '{lic.TEMPLATES[k].label}' END" for k in of)
        return f"coalesce(array_to_string(list_sort(list_distinct([{own}])), ','), '')"

    starts = " || ".join(f"p{k}" for k in base)
    best = f"greatest({', '.join(f'CASE WHEN s{k} >= {lic.LEAST} THEN s{k} ELSE 0.0 END' for k in n)})"
    return f"""
WITH o AS (SELECT doc_id, {words("text")} AS w FROM documents),
a AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM o),
b AS (SELECT doc_id, w, {places} FROM a),
c AS (SELECT *, {", ".join(shares)} FROM b)
SELECT doc_id, len(w)::BIGINT AS n_words, len({starts})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word,
  list_max({starts})::BIGINT AS last_word, {labels(base)} AS base_labels, {labels(n)} AS labels, {best}::DOUBLE AS score
FROM c"""


def urlfilter() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url.RULES)
    d, kinds = url.DAMPING, (("trust", "src", "dst"), ("distrust", "dst", "src"))
    edges = " UNION ALL ".join(f"SELECT '{k}' AS kind, {a} AS a, {b} AS b, {d} / count(*) OVER (PARTITION BY {a}) AS w FROM links" for k, a, b in kinds)
    starts = " UNION ALL ".join(f"SELECT '{k}' AS kind, host AS a, {1 - d} * {k} AS rank FROM seeds WHERE {k} > 0" for k, _, _ in kinds)
    host = f"translate(regexp_extract(coalesce({{}}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"
    link = url.LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {values}) AS v(action, rule_host, rule_path)),
p AS MATERIALIZED (SELECT page_id, {host.format("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hp AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, arg_max(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host) + length(rule_path)) AS x
  FROM hp JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
judged AS MATERIALIZED (SELECT page_id, p.host, p.path, x.rule AS rule, x.action AS action FROM p LEFT JOIN best USING (host, path)),
seeds AS (SELECT host, (count(*) FILTER (action = 'allow') / count(*) > {url.SHARE})::INT AS trust, (count(*) FILTER (action = 'block') / count(*) > {url.SHARE})::INT AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
raw AS (SELECT {host.format("url")} AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM pages),
links AS (SELECT DISTINCT src, translate(dst, '{UPPER}', '{UPPER.lower()}') AS dst FROM raw WHERE src <> '' AND src <> translate(dst, '{UPPER}', '{UPPER.lower()}')),
edges AS MATERIALIZED ({edges}),
r0 AS MATERIALIZED ({starts}),
flow AS (SELECT 0 AS k, kind, a, rank FROM r0 UNION ALL SELECT k + 1, kind, e.b, sum(f.rank * e.w) FROM flow f JOIN edges e USING (kind, a) WHERE k < 150 GROUP BY k, kind, e.b),
ranks AS (SELECT a AS host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM flow GROUP BY a),
bad AS (SELECT host FROM ranks WHERE distrust >= {url.THRESHOLD} AND distrust > trust)
SELECT page_id, judged.host, path, rule, coalesce(action, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN bad ON judged.host = bad.host"""


CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(turn // 64, -1)::BIGINT AS block, replace(coalesce(text, ''), '<|', '< |') AS c FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
v AS (SELECT t.*, speaker, coalesce(role = speaker, false) AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') END || chr(10) AS head,
    c || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
x AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY block, turn NULLS FIRST, role NULLS FIRST, c ROWS UNBOUNDED PRECEDING)::BIGINT AS till FROM v)
SELECT conv_id, speaker, block, count(*)::BIGINT AS n_turns, min(till - length(head) - length(body))::BIGINT AS at, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, c) AS rendered,
  coalesce(string_agg((till - length(body)) || '-' || till, ',' ORDER BY till) FILTER (own), '') AS mask
FROM x GROUP BY conv_id, speaker, block"""


DECONTAMINATE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS w, least(10, len(w)) AS n FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item, n, w[i + 1 : i + n] AS win FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM b WHERE n > 0)),
dp AS MATERIALIZED (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
terms AS MATERIALIZED (SELECT item, win, word, min(i) AS i FROM (SELECT item, win, unnest(range(n)) AS i, unnest(win) AS word FROM iw) GROUP BY item, win, word),
counts AS MATERIALIZED (SELECT word, count(*) AS n FROM dp WHERE word IN (SELECT word FROM terms) GROUP BY word),
ranked AS (SELECT item, win, word, i, row_number() OVER (PARTITION BY item, win ORDER BY n, i) AS nth, count(*) OVER (PARTITION BY item, win) AS known FROM terms JOIN counts USING (word)),
anchors AS MATERIALIZED (SELECT *, least({dec.LEAST}, len(list_distinct(win))) AS wanted FROM ranked WHERE nth <= known - least({dec.LEAST}, len(list_distinct(win))) + 1),
places AS (SELECT r, dp.i - a.i AS s, item, win, wanted FROM dp JOIN anchors a USING (word)),
near AS MATERIALIZED (SELECT places.r, item, s, win, w[greatest(s, 0) + 1 : greatest(s + len(win), 0)] = win AND s >= 0 AS exact
  FROM places JOIN d USING (r) WHERE len(list_intersect(win, w[greatest(s - {dec.SLACK}, 0) + 1 : greatest(s + len(win) + {dec.SLACK}, 0)])) >= wanted),
dw AS (SELECT r, n, i, w[i + 1 : i + n] AS win FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
m AS MATERIALIZED (SELECT r, item, dw.n, i FROM dw JOIN iw USING (n, win)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r),
close AS (SELECT r, count(DISTINCT item) AS n_near FROM (SELECT r, item FROM near UNION ALL SELECT r, item FROM m) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN close USING (r)"""


#: The 256 steps of CRC-32 as a list, and the CRC-32 of a list of bytes; both to be used where ``steps`` is joined in.
STEPS = "steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"


def byte_list(blob: str) -> str:
    return f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT)"


def crc32(codes: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"


MEDIA = rf"""
WITH {STEPS},
t AS (SELECT doc_id, encode(coalesce(text, '')) AS content FROM documents),
p AS (SELECT doc_id, octet_length(content) AS n, content || repeat('\xFF'::BLOB, greatest(1, (octet_length(content) + 575) // 576) * 576 - octet_length(content)) AS samples FROM t),
m AS MATERIALIZED (SELECT *, octet_length(samples) AS size, encode('P5' || chr(10) || '576 ' || octet_length(samples) // 576 || chr(10) || '255' || chr(10)) || samples AS medium, {byte_list("samples")} AS code FROM p),
f AS (SELECT *, list_sum(code)::BIGINT AS total, list_transform(range(64), lambda k: list_sum(code[k * (size // 64) + 1 : (k + 1) * (size // 64)])) AS runs FROM m),
b AS (SELECT *, list_transform(runs, lambda r: CASE WHEN r * 64 > total THEN 1 ELSE 0 END) AS bit FROM f)
SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(samples) AS payload_sha256, {crc32("code[size - 31 : size]")}::BIGINT AS tail_crc32,
  octet_length(medium)::BIGINT AS media_bytes, sha256(medium) AS media_sha256,
  array_to_string(list_transform(range(16), lambda k: lower(hex(bit[4 * k + 1] * 8 + bit[4 * k + 2] * 4 + bit[4 * k + 3] * 2 + bit[4 * k + 4]))), '') || '-' || total // size AS feature
FROM b, steps"""

TRIE = rf"""
WITH {STEPS},
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS said FROM t GROUP BY c),
h AS (SELECT c, said, {crc32(byte_list("encode(c::VARCHAR)"))} % 4 AS h FROM own, steps),
whole AS MATERIALIZED (SELECT h.c, coalesce(list_slice(b.said, 1, h), []) || list_slice(h.said, h + 1, len(h.said)) AS said FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
members AS (SELECT c, said, d, list_slice(said, 1, d) AS node FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (SELECT node, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(said) = d), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].x, '[^\x20\x09-\x0D]+')) * (count(*) - 1) END AS saved FROM members GROUP BY node, d),
children AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
kinds AS MATERIALIZED (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT list_slice(node, 1, k) AS node, sum((n_children = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM kinds) GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, above.leaves::BIGINT AS n_leaves, above.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM kinds k JOIN above USING (node) LEFT JOIN nodes p ON k.d > 0 AND p.node = list_slice(k.node, 1, k.d - 1)"""


def resample() -> str:
    def features(table: str, row: str) -> str:
        return f"SELECT {row} AS i, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM (SELECT *, {words('text')} AS w FROM {table})"

    return rf"""
WITH {STEPS},
docs AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM documents),
df AS MATERIALIZED ({features("docs", "i")}), bf AS MATERIALIZED ({features("benchmark", "0")}),
known AS MATERIALIZED (SELECT f, {crc32(byte_list("encode(f)"))} % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)), steps),
s AS (SELECT bucket, count(*) AS s FROM df JOIN known USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN known USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM df) AS all_s, (SELECT count(*) FROM bf) AS all_t),
gain AS MATERIALIZED (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
w AS (SELECT i, count(*) AS n, sum(gain) AS total FROM df JOIN known USING (f) JOIN gain USING (bucket) GROUP BY i),
o AS (SELECT docs.i, doc_id, len({words("text")}) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN w USING (i)),
z AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
drawn AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank FROM z WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM drawn) // 100 THEN rank END::BIGINT AS rank
FROM z LEFT JOIN drawn USING (i)"""
