r"""DuckDB SQL for the queries that SQL can express."""

_OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, t, md5(t) AS body, copies FROM (SELECT doc_id, coalesce(text, '') AS t, count(*) AS copies FROM documents GROUP BY ALL) x),
e AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS p FROM d),
s0 AS (SELECT rid, doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM e WHERE len(p) > 0),
s1 AS (SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS words FROM s0),
s AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS upto, CAST(sum(words) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) - words AS before, count(*) OVER (PARTITION BY rid) AS n FROM s1),
ends AS (SELECT rid, upto AS w, min(i) AS j FROM s GROUP BY rid, upto),
starts AS (SELECT rid, before AS w, max(i) AS i FROM s GROUP BY rid, before),
fwd AS (SELECT s.rid, s.i, greatest(s.i + 1, ends.j) AS j, s.n FROM s ASOF JOIN ends ON s.rid = ends.rid AND s.before + 20 <= ends.w),
bwd AS (SELECT s.rid, least(s.i - 1, starts.i) AS i, s.i AS j, s.n FROM s ASOF JOIN starts ON s.rid = starts.rid AND s.upto - 20 >= starts.w),
runs AS (SELECT rid, i, j FROM fwd WHERE j <= n UNION SELECT rid, i, j FROM bwd WHERE i >= 1),
texts AS (SELECT r.rid, r.i, r.j, string_agg(regexp_replace(s.piece, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), chr(10) ORDER BY s.i) AS run FROM runs r JOIN s ON s.rid = r.rid AND s.i BETWEEN r.i AND r.j GROUP BY r.rid, r.i, r.j),
ranked AS (SELECT texts.*, row_number() OVER (PARTITION BY run ORDER BY d.doc_id NULLS FIRST, d.body, texts.i, texts.j) AS k FROM texts JOIN d ON d.rid = texts.rid),
gone AS (SELECT DISTINCT s.rid, s.i FROM ranked r JOIN s ON s.rid = r.rid AND s.i BETWEEN r.i AND r.j WHERE r.k > 1),
islands AS (SELECT rid, min(i) AS a, max(i) AS b FROM (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS g FROM gone) x GROUP BY rid, g),
removed AS (SELECT rid, string_agg(CAST(a - 1 AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a) AS removed, sum(b - a + 1) AS m FROM islands GROUP BY rid),
kept AS (SELECT s.rid, string_agg(s.piece, '' ORDER BY s.i) AS body FROM s LEFT JOIN gone ON gone.rid = s.rid AND gone.i = s.i WHERE gone.i IS NULL GROUP BY s.rid)
SELECT e.doc_id, CAST(len(e.p) AS BIGINT) AS n_sentences, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed,
       CAST(length(coalesce(body, '')) AS BIGINT) AS n_kept_chars, sha256(coalesce(body, '')) AS kept_sha256
FROM e JOIN (SELECT rid, unnest(range(copies)) AS copy FROM d) c ON c.rid = e.rid LEFT JOIN removed ON removed.rid = e.rid LEFT JOIN kept ON kept.rid = e.rid
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS win, len(w[i:i+12]) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n),
hits AS (
  SELECT p.rid, p.i, p.n, v.item_id FROM (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM pos) p JOIN wins v ON v.win = p.win AND v.n = p.n),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_OP3 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM u),
q AS (
  SELECT page_id, url, host, path, regexp_replace(host, '^(www|m)\.', '') AS h, regexp_replace(path, '/+$', '') AS t,
         regexp_replace(regexp_replace(query, '(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS a
  FROM p),
c AS (
  SELECT page_id, url, host, path, CASE WHEN host <> '' THEN h || t || CASE WHEN a <> '' THEN '?' || a ELSE '' END END AS canonical FROM q),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT DISTINCT c.host AS host, c.path AS path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS ruled
  FROM (SELECT DISTINCT host, path FROM c) c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.host, c.path),
listed AS (SELECT DISTINCT canonical FROM c WHERE contains(url, 'utm_source=') AND canonical IS NOT NULL)
SELECT c.page_id, c.host, c.path, best.rule AS rule,
       coalesce(best.ruled, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical AS canonical, listed.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best ON best.host = c.host AND best.path = c.path LEFT JOIN listed ON listed.canonical = c.canonical
"""


def _op5() -> str:
    """Water-filling in closed form, and four rounds of seeded selection."""
    sql = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, n, k, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, CAST(2 * n AS DOUBLE) / weight AS ratio FROM w),
f AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(CAST(sum(2 * n) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS rem,
         CAST(sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS wsum
  FROM o),
z AS (SELECT *, CASE WHEN rem * weight > CAST(2 * n AS DOUBLE) * wsum THEN 0 ELSE 1 END AS free FROM f),
y AS (SELECT *, max(free) OVER (ORDER BY ratio, k ROWS UNBOUNDED PRECEDING) AS open FROM z),
first AS (SELECT rem, wsum FROM y WHERE open = 1 ORDER BY ratio, k LIMIT 1),
t AS (
  SELECT y.source, y.n, CASE WHEN open = 0 THEN CAST(2 * y.n AS DOUBLE) ELSE y.weight * first.rem / first.wsum END AS target FROM y LEFT JOIN first ON true),
q AS (
  SELECT source, n, target, least(CAST(floor(target) AS BIGINT), 2 * n) AS take FROM t),
r0 AS (
  SELECT d.doc_id, d.source, d.size, d.h, q.n, q.target, CASE WHEN n > 0 THEN take // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN take % n ELSE 0 END AS room, 0 AS extra, false AS passed
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)"""
    for k in range(4):
        sql += f""",
c{k} AS (
  SELECT *, extra = 0 AND NOT passed AND size > 0 AND size <= room AS may,
         sum(CASE WHEN extra = 0 AND NOT passed AND size > 0 AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM r{k}),
p{k} AS (SELECT *, may AND upto <= room AS yes FROM c{k}),
r{k + 1} AS (
  SELECT doc_id, source, size, h, n, target, whole,
         room - coalesce(sum(CASE WHEN yes THEN size ELSE 0 END) OVER (PARTITION BY source), 0) AS room,
         extra + CASE WHEN yes THEN 1 ELSE 0 END AS extra, passed OR coalesce(h = min(h) FILTER (WHERE may AND NOT yes) OVER (PARTITION BY source), false) AS passed
  FROM p{k})"""
    return sql + """
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size > 0 THEN whole + extra ELSE 0 END * size AS BIGINT) AS taken, CAST(CASE WHEN size > 0 THEN whole + extra ELSE 0 END AS INTEGER) AS copies
FROM r4
"""


def _op10() -> str:
    from haplospark.llm.secrets_scan import RULES

    parts = []
    for rank, r in enumerate(RULES):
        pattern = ("(?s)(.*?)(" + r.pattern + ")").replace("'", "''")
        parts.append(
            f"SELECT doc, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 2), lambda x: length(x)) AS alls, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 3), lambda x: length(x)) AS vals FROM d"
        )
    union = "\n  UNION ALL\n  ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  {union}),
e AS (SELECT doc, rank, kind, least, unnest(gaps) AS gap, unnest(alls) AS whole, unnest(vals) AS val, unnest(range(1, len(gaps) + 1)) AS i FROM m WHERE len(gaps) > 0),
p AS (SELECT *, sum(gap + whole) OVER (PARTITION BY doc, rank ORDER BY i) AS stop FROM e),
f AS (SELECT doc, rank, kind, stop - whole AS start, kind || ':' || CAST(stop - whole AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM p WHERE val >= least),
g AS (
  SELECT doc, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY doc)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc)
"""


_OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, who, said, part, CAST(floor((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, who, said) - 1) / 1024) AS INTEGER) AS piece
  FROM (
    SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS who,
           regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS said, CAST(coalesce(floor(turn / 1024), 0) AS INTEGER) AS part
    FROM conversations) c),
p AS (SELECT DISTINCT conv_id, who AS me FROM t WHERE who <> 'system'),
x AS (
  SELECT t.conv_id, p.me, t.part, t.piece, t.turn, t.who, t.said, t.who = p.me AS own, t.said || '<|end|>' || chr(10) AS body,
         CASE WHEN t.who = 'system' THEN '<|system|>' WHEN t.who = p.me THEN '<|assistant|>' ELSE '<|user name=' || t.who || '|>' END || chr(10) AS head
  FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
y AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w AS stop FROM x WINDOW w AS (PARTITION BY conv_id, me, part, piece ORDER BY turn NULLS FIRST, who, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, me AS perspective, part, piece, CAST(count(*) AS BIGINT) AS n_turns, CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_masked,
       string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS mask
FROM y GROUP BY conv_id, me, part, piece
"""

SQL = {
    "op1_substring_dedup": _OP1,
    "op2_benchmark_decontamination": _OP2,
    "op3_url_filters": _OP3,
    "op5_source_mix": _op5(),
    "op6_chat_formatting": _OP6,
    "op10_secret_scans": _op10(),
}
