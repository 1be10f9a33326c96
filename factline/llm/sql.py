"""DuckDB SQL for the queries that have a relational form."""

from __future__ import annotations

from factline.llm import urls
from factline.llm.licenses import BASE, FURTHER, K

_letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def alnum(text: str = "text") -> str:
    return rf"coalesce(regexp_extract_all(translate({text}, {_letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def spaced(text: str = "text") -> str:
    return rf"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"


def _licenses() -> str:
    grams = []
    for t, x in enumerate(BASE + FURTHER):
        w = x.text.split()
        n = len(w) - K + 1
        grams += [f"({t}, {i}, {n}, '{' '.join(w[i : i + K])}', '{x.label}', {str(x.base).lower()}, {x.slack}, {x.share})" for i in range(n)]
    return rf"""WITH t(template, t_at, n_grams, gram, label, base, slack, share) AS (VALUES {", ".join(grams)}),
w AS (SELECT doc_id, {alnum()} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, greatest(len(w) - {K - 1}, 0))) AS pos, w FROM w),
v AS (SELECT doc_id, template, n_grams, label, base, slack, share, pos - t_at AS diagonal, list(t_at) AS places FROM (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {K}], ' ') AS gram FROM g) JOIN t USING (gram) GROUP BY ALL),
s AS (SELECT a.doc_id, a.template, a.label, a.base, a.slack, a.share, a.diagonal, len(list_distinct(flatten(list(b.places))))::DOUBLE / a.n_grams AS score FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.template = b.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + a.slack GROUP BY a.doc_id, a.template, a.label, a.base, a.slack, a.share, a.diagonal, a.n_grams),
sp AS (SELECT doc_id, label, base, share, diagonal AS first, CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.template = s.template AND abs(x.diagonal - s.diagonal) <= s.slack AND (x.score > s.score OR x.score = s.score AND x.diagonal < s.diagonal)) THEN 0.0 ELSE score END AS score FROM s),
a AS (SELECT doc_id, count(*) FILTER (base AND score >= share) AS n_base, min(first) FILTER (base AND score >= share) AS first_word, max(first) FILTER (base AND score >= share) AS last_word,
  list_sort(list_distinct(list(label) FILTER (base AND score >= share))) AS b, list_sort(list_distinct(list(label) FILTER (score >= share))) AS a, max(score) AS score, count(*) FILTER (score >= share) AS n_spans FROM sp GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(a, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN a USING (doc_id)"""


_host = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_letters})"
_path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _urls() -> str:
    longest_first = sorted(urls.RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: f"CASE {' '.join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest_first)} END"
    link = urls.LINK.replace("'", "''")
    steps = []
    for kind, node, to in (("trust", "source", "target"), ("distrust", "target", "source")):
        steps.append(f"m_{kind} AS MATERIALIZED (SELECT {node} AS node, {to} AS dest, n / sum(n) OVER (PARTITION BY {node}) AS share FROM e WHERE source <> target UNION ALL SELECT host, host, 1.0 FROM k WHERE host NOT IN (SELECT {node} FROM e WHERE source <> target))")
        steps.append(f"{kind}0 AS MATERIALIZED (SELECT host AS node, coalesce(s.{kind}, 0.0) AS score, 1.0::DOUBLE AS base FROM k LEFT JOIN s USING (host))")
        moved = lambda own, c: f"{1 - urls.DAMPING!r}::DOUBLE * {own} + {urls.DAMPING}::DOUBLE * coalesce(g.{c}, 0.0) AS {c}"
        for i in range(1, urls.STEPS + 1):
            steps.append(f"{kind}{i} AS MATERIALIZED (SELECT z.node, {moved('z.score', 'score')}, {moved('1.0', 'base')} FROM {kind}0 z LEFT JOIN (SELECT dest AS node, sum(share * score) AS score, sum(share * base) AS base FROM m_{kind} JOIN {kind}{i - 1} USING (node) GROUP BY dest) g USING (node))")
    return f"""WITH p0 AS (SELECT page_id, html, {_host} AS host, {_path} AS path FROM pages), p AS MATERIALIZED (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p0),
l AS MATERIALIZED (SELECT host AS source, target, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_concat([host], [translate(x, {_letters}) FOR x IN regexp_extract_all(coalesce(html, ''), '{link}', 1)]))) AS target FROM p WHERE host <> '') GROUP BY ALL),
s AS (SELECT host, avg(coalesce((ruled = 'allow')::INT, 0)) AS trust, avg(coalesce((ruled = 'block')::INT, 0)) AS distrust FROM p WHERE host <> '' GROUP BY host),
k AS MATERIALIZED (SELECT source AS host FROM l UNION SELECT target FROM l),
f AS (SELECT a.host, arg_max(b.host, len(b.host)) AS parent FROM k a JOIN k b ON ends_with(a.host, '.' || b.host) WHERE len(a.host) <= {urls.LONGEST} GROUP BY a.host),
e AS MATERIALIZED (SELECT source, target, sum(n) AS n FROM (SELECT * FROM l UNION ALL SELECT host, parent, 1 FROM f UNION ALL SELECT parent, host, 1 FROM f) GROUP BY ALL), {", ".join(steps)},
h AS (SELECT node AS host, a.score / a.base AS trust, b.score / b.base AS distrust FROM trust{urls.STEPS} a JOIN distrust{urls.STEPS} b USING (node))
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN round(distrust - trust, 9) > {urls.BALANCE} THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust FROM p LEFT JOIN h ON h.host = p.host"""


def _fim() -> str:
    h = lambda i: f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT"
    cut = lambda a, b: f"array_to_string(u[{a} : {b}], '')"
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
c AS (SELECT *, least({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) AS a, greatest({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h(2)} % 100 >= 50 THEN 'plain' WHEN {h(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
x AS (SELECT *, {cut("1", "a")} AS prefix, {cut("a + 1", "b")} AS middle, {cut("b + 1", "len(u)")} AS suffix FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""


ORACLES = {
    "op11_fill_in_middle": _fim(),
    "op12_url_filter": _urls(),
    "op1_license_scan": _licenses(),
    "op2_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, {spaced(f"translate(text, {_letters})")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i + 1 : i + 5] END AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.reached), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id, n.n""",
    "op3_benchmark_decontamination": rf"""WITH w AS (SELECT doc_id, {alnum()} AS w FROM documents), b AS (SELECT item_id, {alnum()} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, CASE WHEN len(w) <= 10 THEN w ELSE w[i + 1 : i + 10] END AS win FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS k FROM x),
d AS (SELECT doc_id, k, i, w[i + 1 : i + k] AS win FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM w, k)),
h AS (SELECT DISTINCT d.doc_id, d.i, d.k, x.item_id FROM d JOIN x USING (win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op7_quality_rules": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {spaced()} AS w FROM documents),
g AS (SELECT doc_id, i, w[i + 1 : i + 5] AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM c WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{Ll}}')) AS n_lower FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_upper > n_lower) AS kept FROM m""",
    "op8_mixing": rf"""WITH s AS (SELECT doc_id, source, CAST(len({spaced()}) AS BIGINT) AS size, ('0x' || substr(md5('8:' || doc_id), 1, 10))::BIGINT AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM s GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER k AS rn, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM t WINDOW k AS (ORDER BY 2.0 * source_size / weight, source IS NULL, encode(source))),
v AS (SELECT arg_min(here, rn) AS level FROM c WHERE cap > here * weight),
g AS (SELECT source, source_size, weight, CASE WHEN cap > here * weight THEN level * weight ELSE cap END AS target FROM c LEFT JOIN v ON true),
p AS (SELECT s.*, g.source_size, g.target, CASE g.weight WHEN 3.0 THEN 1.5 WHEN 1.0 THEN 0.5 ELSE 1.0 END::DOUBLE AS a, CASE g.weight WHEN 3.0 THEN 0.5 WHEN 1.0 THEN 1.5 ELSE 1.0 END::DOUBLE AS z, CAST(round(g.target) AS BIGINT) AS want, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begin FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
u AS (SELECT *, CAST(greatest(0, least(size, want - begin)) AS BIGINT) AS one, CAST(greatest(0, least(size, want - begin - source_size)) AS BIGINT) AS two FROM p),
k AS (SELECT *, (a + z) / 2 * (begin / target) AS first_area, (a + z) / 2 * ((begin + CASE WHEN two > 0 THEN source_size ELSE 0 END) / target) AS last_area FROM u)
SELECT doc_id, size, source_size, target, one + two AS taken, CASE WHEN one > 0 THEN round(least(1.0, 2 * first_area / (a + sqrt(a * a + 2 * (z - a) * first_area))), 6) END AS position,
  CASE WHEN one > 0 THEN round(least(1.0, 2 * last_area / (a + sqrt(a * a + 2 * (z - a) * last_area))), 6) END AS last_position FROM k""",
    "op9_warc_zip": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), k AS (SELECT body, max(page_id) AS keep FROM p WHERE octet_length(body) >= 1000 GROUP BY body HAVING count(*) > 1)
SELECT page_id, octet_length(p.body) AS payload_bytes, sha1(p.body) AS payload_digest, CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM p LEFT JOIN k ON p.body = k.body""",
    "op10_lm_score": rf"""WITH w AS (SELECT doc_id, {alnum()} AS w FROM documents), x AS (SELECT doc_id, i, w[i] AS v, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
t AS (SELECT count(*) AS t FROM x), c1 AS (SELECT v, count(*) AS c FROM x GROUP BY v), c2 AS (SELECT u, v, count(*) AS c FROM x WHERE u IS NOT NULL GROUP BY ALL),
o1 AS (SELECT doc_id, v, count(*) AS c FROM x GROUP BY ALL), o2 AS (SELECT doc_id, u, v, count(*) AS c FROM x WHERE u IS NOT NULL GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
y AS (SELECT x.doc_id, x.u IS NULL AS first, c1.c - o1.c AS one, c2.c - o2.c AS two, cu.c - ou.c AS ctx, t - n.n AS rest FROM x JOIN n USING (doc_id), t, c1, o1, c1 cu, o1 ou, c2, o2 WHERE c1.v = x.v AND o1.v = x.v AND o1.doc_id = x.doc_id AND cu.v = coalesce(x.u, x.v) AND ou.v = coalesce(x.u, x.v) AND ou.doc_id = x.doc_id AND c2.u = x.u AND c2.v = x.v AND o2.doc_id = x.doc_id AND o2.u = x.u AND o2.v = x.v
  UNION ALL SELECT x.doc_id, true, c1.c - o1.c, 0, 0, t - n.n FROM x JOIN n USING (doc_id), t, c1, o1 WHERE x.u IS NULL AND c1.v = x.v AND o1.v = x.v AND o1.doc_id = x.doc_id),
z AS (SELECT doc_id, count(*) AS n, sum((two > 0)::INT) AS seen, sum(CASE WHEN two > 0 THEN ln(two) - ln(ctx) ELSE CASE WHEN first THEN 0 ELSE ln(0.4) END + CASE WHEN one > 0 THEN ln(one) - ln(greatest(rest, 1)) ELSE -ln(rest + 1) END END) AS s FROM y GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(seen, 0) AS BIGINT) AS n_seen, round(coalesce(s, 0.0), 6) AS log_score, round(s / n, 6) AS mean_log_score FROM w LEFT JOIN z USING (doc_id)""",
}
