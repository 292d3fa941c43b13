"""DuckDB SQL of the training-data queries that SQL can express."""

import re

from .secrets import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
top AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN top USING (payload_digest)
"""

OP8 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
),
rules(verdict, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fit AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := rules.rule, verdict := rules.verdict), length(rules.rule)) FROM rules WHERE (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p)) AS f FROM u
),
listed AS (SELECT host, coalesce(max(f.verdict = 'block'), false) AS blocked FROM fit GROUP BY host)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM fit JOIN listed USING (host)
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the lengths of the stretches between matches and of the matches add up to the offsets."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS a, length(hit[i]) AS len
FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {group}) AS part, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d) WHERE length(part[i]) >= {least}"""


def _op1() -> str:
    kinds = []
    for order, r in enumerate(RULES):
        pattern, group = r.pattern, r.group
        if r.flags:  # ASCII letters in either case; RE2's own flag folds others too
            head, _, tail = pattern.partition(")")
            pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + tail
        if group == 0:
            pattern, group = f"({pattern})", 1
        kinds.append(_spans(r.kind, order, pattern, group, r.least))
    count = lambda k: f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}"
    span = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len AS BIGINT)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(kinds)}),
g AS (SELECT doc_id, {', '.join(map(count, ('assign', 'access', 'hex')))}, string_agg({span}, ',' ORDER BY a, o) FILTER ({base}) AS base, string_agg({span}, ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP11 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc, i, regexp_extract_all(pieces[i], '[^\x20\x09]+') AS w
  FROM (SELECT lang, doc, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT lang, row_number() OVER () AS doc, regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))
),
total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
phrases AS (
  SELECT lang, w[i:i + k - 1] AS ph, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS sizes(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100
),
cand AS (SELECT * FROM phrases WHERE len(ph) > 1),
cuts AS (
  SELECT c.lang, c.ph, c.a, k, x.a AS l, y.a AS r, n, CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM cand) c JOIN total USING (lang)
  JOIN phrases x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN phrases y ON y.lang = c.lang AND y.ph = c.ph[k + 1:]
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (SELECT lang, ph[s:s + m - 1] AS ph, max(a) AS longer FROM (SELECT lang, ph, a, m, unnest(range(1, len(ph) - m + 2)) AS s FROM cand, range(2, 5) AS sizes(m) WHERE m < len(ph)) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.ph, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.ph = best.ph WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

#: The CRC-32 of the digits of a number, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END), 4294967295))"

OP12 = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(m ORDER BY i) AS own, {_CRC} % 6 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(base.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c base ON base.conv_id = c.conv_id - c.conv_id % 100),
path AS (SELECT conv_id, len(seq) AS total, d, seq[1:d] AS pre FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM b)),
node AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '') AS ends FROM path GROUP BY d, pre),
kids AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * length(node.pre[-1].text) END AS v FROM node LEFT JOIN kids ON kids.d = node.d AND kids.pre = node.pre),
sub AS (SELECT a.d, a.pre, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.v) AS saved FROM full_ a JOIN (SELECT *, unnest(range(0, d + 1)) AS up FROM full_) u ON u.up = a.d AND u.pre[1:u.up] = a.pre GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub ON sub.d = f.d AND sub.pre = f.pre LEFT JOIN node p ON p.d = f.d - 1 AND p.pre = f.pre[1:f.d - 1]
"""

SQL: dict[str, str] = {"op11_phrase_collocation_mining": OP11, "op12_conversation_prefix_trie": OP12, "op1_secret_scans": _op1(), "op2_benchmark_decontamination": OP2, "op4_warc": OP4, "op6_ngram_jaccard_join": OP6, "op8_url_filters": OP8}
