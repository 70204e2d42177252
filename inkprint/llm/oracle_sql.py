"""The same queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""

TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([a.q[i] * b.q[i] FOR i IN generate_series(1, len(a.q))]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

DECONTAMINATE = f"""
WITH items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS grams
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), places AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS grams
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM docs, (SELECT DISTINCT len(grams) AS n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.s, p.n, k.item_id FROM places p JOIN windows k ON p.grams = k.grams
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), frequent AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY doc_id
"""

_SECOND = "ac|co|com|edu|gov|gob|go|mil|ne|net|nom|or|org"


def _parts(host: str) -> str:
    name = rf"regexp_replace(regexp_replace({host}, '\A.*@', ''), '(:[0-9]*)?\.?\z', '')"
    domain = rf"regexp_extract({name}, '([^.]+\.(?:(?:(?:{_SECOND})\.)[^.]{{2}}|[^.]+))\z', 1)"
    suffix = rf"regexp_extract({name}, '(?:\A|\.)((?:(?:{_SECOND})\.)?[^.]{{2}}|[^.]+)\z', 1)"
    numeric = rf"regexp_matches({name}, '\A([0-9.]+|\[.*\])\z')"
    return f"""CASE WHEN {name} = '' THEN NULL WHEN {numeric} OR {domain} = '' THEN {name} ELSE {domain} END AS domain,
       CASE WHEN {name} = '' THEN NULL WHEN {numeric} THEN 'address' ELSE {suffix} END AS suffix"""


def _level(name: str, counted: str, parents: str, on: str) -> str:
    """Counts of a level with their centre, the level's prior weight, and posterior counts."""
    chance = "n * c * (1 - c)"
    return f"""
{name}_c AS (SELECT l.*, p.a / (p.a + p.b) AS c FROM ({counted}) l JOIN {parents} p ON {on}),
{name}_w AS (
  SELECT coalesce(max(w), 10000.0::DOUBLE) AS w FROM (
    SELECT greatest(CASE WHEN rho > 0 THEN least(1 / rho - 1, 10000.0::DOUBLE) ELSE 10000.0::DOUBLE END, 1.0::DOUBLE) AS w
    FROM (SELECT round(sum((bad - n * c) * (bad - n * c) - {chance}) / nullif(sum(n * (n - 1) * c * (1 - c)), 0), 9) AS rho FROM {name}_c))),
{name}_l AS (SELECT l.* EXCLUDE (c), bad + w * c AS a, n - bad + w * (1 - c) AS b FROM {name}_c l, {name}_w)"""


URL_FILTER = rf"""
WITH urls AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM urls
), parted AS (
  SELECT *, {_parts('host')}, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html|/)?\z', 1) AS BIGINT) AS doc_id FROM split
), outcomes AS (
  SELECT host, domain, suffix, count(*) AS n, count(*) FILTER (bad) AS bad
  FROM parted JOIN (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id) USING (doc_id)
  WHERE bad IS NOT NULL AND host <> '' AND domain IS NOT NULL GROUP BY host, domain, suffix
), all_l AS (
  SELECT coalesce(sum(bad), 0) + 0.5::DOUBLE AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 0.5::DOUBLE AS b FROM outcomes
), {_level('suffix', 'SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM outcomes GROUP BY suffix', 'all_l', 'true')},
{_level('domain', 'SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM outcomes GROUP BY domain, suffix', 'suffix_l', 'l.suffix = p.suffix')},
{_level('host', 'SELECT * FROM outcomes', 'domain_l', 'l.domain = p.domain AND l.suffix = p.suffix')},
rules AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
    AS r(rule_verdict, rule_host, rule_path)
), ruled AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parted) JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
), posterior AS (
  SELECT p.page_id, p.host, p.path, p.domain, h.n, coalesce(h.a, least(host_w.w, t.a + t.b) * t.a / (t.a + t.b)) AS a,
         coalesce(h.b, least(host_w.w, t.a + t.b) * (1 - t.a / (t.a + t.b))) AS b
  FROM (SELECT parted.*, coalesce(d.a, s.a, g.a) AS na, coalesce(d.b, s.b, g.b) AS nb, struct_pack(a := na, b := nb) AS t
        FROM parted LEFT JOIN domain_l d ON parted.domain = d.domain AND parted.suffix = d.suffix
          LEFT JOIN suffix_l s ON parted.suffix = s.suffix, all_l g) p
    LEFT JOIN host_l h ON p.host = h.host, host_w
), judged AS (
  SELECT *, CASE WHEN domain IS NOT NULL THEN a / (a + b) END AS mean,
         CASE WHEN domain IS NOT NULL THEN round(greatest(a / (a + b) - 1.645::DOUBLE * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 0), 9) END AS bound
  FROM posterior
)
SELECT j.page_id, j.host, j.path, r.rule, coalesce(r.rule_verdict, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN domain IS NOT NULL THEN coalesce(n, 0) END::BIGINT AS n_outcomes, round(mean, 6) AS bad_share, round(bound, 6) AS bad_bound
FROM judged j LEFT JOIN ruled r ON j.page_id IS NOT DISTINCT FROM r.page_id AND j.host = r.host AND j.path = r.path
"""

ORACLES = {
    "op2_topk": TOPK,
    "op3_decontaminate": DECONTAMINATE,
    "op10_line_dedup": LINE_DEDUP,
    "op11_url_filter": URL_FILTER,
}
