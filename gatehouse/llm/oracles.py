"""The same queries in DuckDB SQL where SQL can express them, for comparison. They share no code with the operators.

SQL goes over whole tables: strings that repeat are found by grouping every window, links by counting shared shingles, components by
carrying the smallest id along links until none changes.
"""

from __future__ import annotations

LENGTH = 400

#: Windows are grouped by a hash of their bytes; documents are cut at every byte.
_REPEATS = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, md5(b[p:p + {LENGTH - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS p FROM d WHERE octet_length(b) >= {LENGTH})),
s AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} OR lag(p) OVER (PARTITION BY r ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM g),
x AS (SELECT r, min(p) AS a, max(p) + {LENGTH - 1} AS z FROM i GROUP BY r, run),
o AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM x),
k AS (SELECT r, sum(z - a + 1) AS gone, count(*) AS n, max(z) AS last, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS kept FROM o JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[last + 1:octet_length(b)]))) END AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reached(links: str, ids: str) -> str:
    """Tables that end in c(id, component_id), from links(a, b) both ways and ids: min labels are carried along links until nothing changes."""
    return f"""reach(id, component_id) USING KEY (id) AS (SELECT id, id FROM {ids}
  UNION SELECT l.b, min(s.component_id) FROM reach s JOIN {links} l ON l.a = s.id JOIN recurring.reach o ON o.id = l.b WHERE s.component_id < o.component_id GROUP BY l.b)"""


_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
ids AS (SELECT doc_id AS id FROM n), {_reached("l", "ids")}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN reach ON id = doc_id"""

_CHAT = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, '\\\\|<s>|</s>|\\[/?INST\\]|\\[/?ROLE\\]')) + length(text) + len(regexp_extract_all(text, '\\\\|<s>|</s>|\\[/?INST\\]|\\[/?ROLE\\]')) + CASE WHEN role = 'assistant' THEN 17 ELSE 26 END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(size) + 3)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
m AS (SELECT a, count(*) AS n FROM l GROUP BY a), ids AS (SELECT vec_id AS id FROM v), {_reached("l", "ids")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN m ON a = vec_id JOIN reach ON id = vec_id"""

#: One slot at a time: of the sources whose next block is released the one with the earliest deadline, the first of equals; a source's last block begins a phase.
_MIXING = """WITH RECURSIVE k AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key FROM documents),
z AS (SELECT key, count(*) AS n FROM k GROUP BY key), q0 AS (SELECT key, n, sqrt(n::DOUBLE) AS v FROM z),
w AS (SELECT key, n, greatest(1, round(v / (SELECT sum(v) FROM q0) * 1024))::BIGINT AS q, (n + 63) // 64 AS blocks FROM q0),
one AS (SELECT list(key ORDER BY key) AS keys, list(q ORDER BY key) AS q, list(blocks ORDER BY key) AS rest FROM w),
e(slot, began, c, j, num, q, done, used, rest, w) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, q, list_transform(q, lambda x: 0::BIGINT), list_transform(q, lambda x: 0::BIGINT), rest, q FROM one WHERE len(q) > 0
  UNION ALL SELECT slot + 1, CASE WHEN ended THEN slot + 2 ELSE began END, i, jth, number, CASE WHEN ended THEN list_transform(w, lambda x, k: CASE WHEN left_[k] > 0 THEN x ELSE 0 END) ELSE q END,
    CASE WHEN ended THEN list_transform(q, lambda x: 0::BIGINT) ELSE list_transform(done, lambda x, k: x + (k = i)::BIGINT) END, list_transform(used, lambda x, k: x + (k = i)::BIGINT), left_, w
  FROM (SELECT *, done[i] AS jth, used[i] AS number, list_transform(rest, lambda x, k: x - (k = i)::BIGINT) AS left_, rest[i] = 1 AS ended
    FROM (SELECT *, list_sort(list_filter(list_transform(q, lambda x, k: CASE WHEN x > 0 AND done[k] * list_sum(q) // x <= slot + 1 - began THEN [((done[k] + 1) * list_sum(q) + x - 1)::BIGINT // x, k] END), lambda x: x IS NOT NULL))[1][2] AS i FROM e WHERE list_sum(rest) > 0))),
s AS (SELECT slot, keys[c] AS key, num AS block, j, lag(began) OVER (ORDER BY slot) AS t, lag(e.q) OVER (ORDER BY slot) AS was, c FROM e, one),
r AS (SELECT key, block, slot, (t + j * list_sum(was) // was[c])::BIGINT AS release, (t + ((j + 1) * list_sum(was) + was[c] - 1) // was[c])::BIGINT AS deadline FROM s WHERE slot >= 0),
f AS (SELECT r.*, sum(least(64, n - 64 * block)) OVER (ORDER BY slot) - least(64, n - 64 * block) AS lead FROM r JOIN z USING (key)),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY substr(md5(doc_id::VARCHAR), 1, 15), doc_id) - 1 AS idx FROM k)
SELECT doc_id, source, block, slot, release, deadline, (lead + idx % 64)::BIGINT AS position FROM d JOIN f ON f.key = d.key AND f.block = d.idx // 64"""

#: Units are a list; cuts, forms and parts are built from it.
_INFILL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _level(name: str, nodes: str) -> str:
    """Tables {name}_s and {name}: nodes with their prior m, and the posterior mean."""
    return f"""{name}_n AS ({nodes}),
{name}_s AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001))) - 1 AS s FROM {name}_n),
{name} AS (SELECT *, (bad + s * m) / (n + s) AS mean FROM {name}_n, {name}_s)"""


#: Every url is held against every rule.
_HOSTS = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_SMALL}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id HAVING max(greatest(1 - quality, toxic)) IS NOT NULL),
h AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM p LEFT JOIN o USING (page_id) GROUP BY host),
{_level("a", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM h) GROUP BY suffix")},
{_level("b", "SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(a.mean) AS m FROM h JOIN a USING (suffix) GROUP BY h.domain, h.suffix")},
{_level("c", "SELECT h.host, h.n, h.bad, b.mean AS m FROM h JOIN b USING (domain)")},
v AS (SELECT host, n, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound FROM c),
x(rh, rp, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(says, length(rh || rp)) AS says FROM (SELECT DISTINCT host, path FROM p) JOIN x ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(says, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n AS n_outcomes, round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound FROM p JOIN v USING (host) LEFT JOIN f ON f.host = p.host AND f.path = p.path"""

ORACLES = {"op2_mixing": _MIXING, "op4_suffixes": _REPEATS, "op5_minhash": _NEAR, "op9_chat": _CHAT, "op10_vectors": _VECTORS, "op11_infill": _INFILL, "op13_hosts": _HOSTS}
