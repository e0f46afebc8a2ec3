"""DuckDB SQL for the queries of this subpackage that SQL can express.

None for: op1 (lattice), op3 and op7 (trained models), op4 (ordered rules),
op5 (a seeded hash that DuckDB lacks), op6 (BM25 with verification), op8 (learnt
references), op9 and op11 (exact components of a similarity graph over all documents)
and the pipeline. These are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from quern.llm import secret_scan as S


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, least: int, group: int, more: str = "true") -> str:
    """Rows (doc_id, kind, start, end_at) of one kind: lengths of gaps and matches, summed up in order."""
    rank = S.KINDS.index(kind)
    return f"""SELECT doc_id, {rank} AS rank, b AS start, b + length(m) AS end_at FROM (
      SELECT doc_id, m, v, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS b FROM (
        SELECT doc_id, unnest(g[1:len(m)]) AS g, unnest(m) AS m, unnest(v) AS v, unnest(range(len(m))) AS k FROM (
          SELECT doc_id, regexp_split_to_array(t, {_literal(pattern)}) AS g, regexp_extract_all(t, {_literal(pattern)}) AS m, regexp_extract_all(t, {_literal(pattern)}, {group}) AS v FROM docs WHERE regexp_matches(t, {_literal(pattern)})))
      WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)) WHERE length(v) >= {least} AND {more}"""


def _op2() -> str:
    # without look-around and groups that extract: the same matches, stated for RE2
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    split_assign = assign.replace("([A-Za-z0-9+/_.=-]+)", "(?:[A-Za-z0-9+/_.=-]+)")
    allow = " OR ".join(f"regexp_matches(v, {_literal(a)})" for a in S.ALLOW if "\\1" not in a) + " OR length(replace(v, v[1], '')) = 0"
    bits = "list_max(list_transform(range(1, length(v) - 18), lambda i: list_aggregate(string_split(substring(v, i, 20), ''), 'entropy')))"
    verdict = " ".join(f"WHEN regexp_matches(v, {_literal(p)}) THEN {'false' if least is None else f'{bits} >= {least}'}" for _, p, least in S.CLASSES)
    base = [
        _spans("assign", assign, S.LEAST["assign"], 1).replace(f"regexp_split_to_array(t, {_literal(assign)})", f"regexp_split_to_array(t, {_literal(split_assign)})"),
        _spans("access", "AKIA[A-Z0-9]+", S.LEAST["access"], 0),
        _spans("hex", "[0-9a-f]{16,}", S.LEAST["hex"], 0),
    ]
    words = _literal(S.ALLOW_WORDS)
    joined = "coalesce(string_agg(kind || ':' || start || ':' || end_at, ',' ORDER BY start, rank){f}, '')"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(base)}),
runs AS ({_spans("entropy", "[A-Za-z0-9+/=_-]{20,}", 20, 0).replace(" FROM (", ", m FROM (", 1)}),
marks AS (SELECT r.doc_id, r.start AS run, m, b.start AS bs, b.end_at AS be FROM runs r JOIN base b ON b.doc_id = r.doc_id AND b.start < r.end_at AND r.start < b.end_at
  UNION ALL SELECT doc_id, start, m, end_at, end_at FROM runs),
gaps AS (SELECT doc_id, run, m, bs, greatest(run, coalesce(max(be) OVER (PARTITION BY doc_id, run ORDER BY bs, be ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), run)) AS a FROM marks),
rests AS (SELECT doc_id, a, substring(m, (a - run + 1)::BIGINT, (bs - a)::BIGINT) AS r FROM gaps WHERE bs - a >= 20),
cut AS (SELECT doc_id, a, unnest(g) AS v, unnest(list_concat([''], h)) AS h, unnest(range(len(g))) AS k FROM (
  SELECT doc_id, a, regexp_split_to_array(r, {words}) AS g, regexp_extract_all(r, {words}) AS h FROM rests)),
cand AS (SELECT doc_id, v, a + sum(length(v) + length(h)) OVER (PARTITION BY doc_id, a ORDER BY k ROWS UNBOUNDED PRECEDING) - length(v) AS start FROM cut),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, 3, start, start + length(v) FROM cand WHERE length(v) >= 20 AND NOT ({allow}) AND CASE {verdict} END),
named AS (SELECT doc_id, rank, ['assign', 'access', 'hex', 'entropy'][rank + 1] AS kind, start::BIGINT AS start, end_at::BIGINT AS end_at FROM every)
SELECT d.doc_id, count(*) FILTER (n.rank = 0)::BIGINT AS n_assign, count(*) FILTER (n.rank = 1)::BIGINT AS n_access, count(*) FILTER (n.rank = 2)::BIGINT AS n_hex,
  sha256({joined.format(f=" FILTER (n.rank < 3)")}) AS base_sha256, {joined.format(f=" FILTER (n.rank IS NOT NULL)")} AS spans, count(*) FILTER (n.rank = 3)::BIGINT AS n_entropy
FROM docs d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


OP10 = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
t AS (SELECT html, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN coalesce(top, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN coalesce(top, page_id) <> page_id THEN top END AS refers_to, url AS target_uri, true AS has_request
FROM p LEFT JOIN t ON p.html = t.html"""


#: The table of the checksum (polynomial 0xEDB88320), as the CTE crc(t).
CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text, byte by byte, beside ``crc`` in the FROM clause."""
    byte = lambda k: f"(instr('0123456789ABCDEF', substring(hex({text}), {k}, 1)) - 1)"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda k: 16 * {byte('(2 * k - 1)::INT')} + {byte('(2 * k)::INT')})"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


OP13 = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
h AS (SELECT *, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")}::BIGINT AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i::INT - 1) || substring(word, i::INT + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT DISTINCT d.word, v.word AS near, v.n AS near_n FROM d JOIN v ON v.word = d.less
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less
  UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN f ON f.word = w.next)
SELECT f.*, root FROM f JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)"""


OP12 = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, s, c - ((c % 20) + 20) % 20 AS base, ({_crc32("(c::VARCHAR)")})::BIGINT % 4 AS h FROM own, crc),
whole AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.base),
prefix AS (SELECT c, d, s[1:d] AS p, d = len(s) AS last FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM whole)),
node AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM prefix GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS up, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT node.p, d, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(list_filter(regexp_split_to_array(node.p[-1].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved FROM node LEFT JOIN kids ON kids.up = node.p),
sums AS (SELECT p[1:k] AS p, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM own_sums) GROUP BY 1)
SELECT x.c AS conv_id, x.d AS depth, up.c AS parent_conv_id, x.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM node x JOIN sums ON sums.p = x.p LEFT JOIN kids ON kids.up = x.p LEFT JOIN node up ON up.p = x.p[1:x.d - 1] AND x.d > 0"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _op2(), "op10_warc": OP10, "op12_prefix_trie": OP12, "op13_spelling_variants": OP13}
