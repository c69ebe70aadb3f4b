"""DuckDB SQL of the query keys that SQL expresses."""

from __future__ import annotations

from pitwise.llm.license_scan import FAMILIES, TEMPLATES, bigrams, bounds, marks

# The first canonical link and the first refresh of a page as written; the given pages hold none, and what
# the operator reads beyond that (all links, comments, base, dot segments) is tested by verdicts written by hand.
_URL = """
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') - 1) ELSE '' END AS scheme
  FROM pages),
h AS (
  SELECT page_id, url, html, scheme, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS authority,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '') AS tail
  FROM p),
links AS (
  SELECT *, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1)]) AS link
  FROM h WHERE host <> ''),
whole AS (
  SELECT host || tail AS u,
    CASE WHEN strpos(link, '://') > 0 THEN substr(link, strpos(link, '://') + 3)
         WHEN link LIKE '//%' THEN substr(link, 3)
         WHEN link LIKE '/%' THEN authority || link
         ELSE authority || CASE WHEN regexp_extract(path, '^(.*/)?') = '' THEN '/' ELSE regexp_extract(path, '^(.*/)?') END || link END AS rest
  FROM links WHERE link <> ''),
edge AS (
  SELECT DISTINCT u, lower(regexp_extract(rest, '^[^/?#]*')) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v
  FROM whole WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
pair AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v),
reach AS (SELECT u AS a, u AS b FROM pair UNION SELECT r.a, e.v FROM reach r JOIN pair e ON r.b = e.u),
rules(verdict, name, prefix, text) AS (VALUES
  ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
  ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')),
node_rule AS (
  SELECT b, arg_max(verdict, length(text)) AS verdict
  FROM (SELECT DISTINCT b, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach) n
  JOIN rules r ON (n.host = r.name OR n.host LIKE '%.' || r.name) AND starts_with(n.path, r.prefix)
  GROUP BY b),
alias AS (
  SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS decision
  FROM reach LEFT JOIN node_rule USING (b) GROUP BY a),
own AS (
  SELECT h.page_id, h.url, h.host, h.path, h.tail, arg_max(r.text, length(r.text)) AS rule, arg_max(r.verdict, length(r.text)) AS verdict
  FROM h LEFT JOIN rules r ON h.host <> '' AND (h.host = r.name OR h.host LIKE '%.' || r.name) AND starts_with(h.path, r.prefix)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(own.verdict, decision, 'allow') AS verdict
FROM own LEFT JOIN alias ON host <> '' AND host || tail = a
"""

_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, s, l, array_to_string(w[s : s + l - 1], ' ') AS t
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
m AS (SELECT DISTINCT r, s, dw.l, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.l = iw.l),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + l)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
last AS (SELECT x, max(page_id) AS top FROM d GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(d.x, (i // 8)::INT * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN last ON d.x = last.x
"""

_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.g IN (SELECT g FROM often) GROUP BY 1, 2),
link AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 90 * (p.n + q.n - m)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least_.b, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = doc_id
"""

_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s : s + k - 1], ' '))) AS phrase
  FROM p, range(1, 5) t(k) WHERE len(w) >= k),
every AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
f AS MATERIALIZED (SELECT * FROM every WHERE f >= 30),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM every WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c),
score AS (
  SELECT cut.lang, cut.phrase, cut.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * cut.a) // (x.f::HUGEINT + y.f) AS score
  FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1 : cut.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM score) WHERE o = 1),
inside AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS s FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_MINHASH = (
    "SELECT *, doc_id = component_id AS kept FROM ("
    + _JACCARD.replace("w[i : i + 2]", "w[i : i + 3]").replace("greatest(1, len(w) - 2)", "greatest(1, len(w) - 3)").replace(">= 90 *", ">= 80 *")
    + ")")

_REPEATS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM win WHERE h IN (SELECT h FROM again)),
word AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def _license() -> str:
    """Lines, paragraphs and texts; windows of a text are left to the tests
    against brute force."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        grams = bigrams(text)
        lo, hi = bounds(len(grams), 80)
        many = lambda x: f"[{', '.join(map(quote, x))}]::VARCHAR[]"
        must, never = marks(name, text)
        rows.append(f"({k}, {quote(name)}, {int(name in FAMILIES)}, {many(grams)}, {many(must)}, {many(never)}, {lo}, {hi})")
    return rf"""
WITH t(k, name, family, grams, must, never, lo, hi) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS flat FROM documents),
u AS (
  SELECT r, list_concat(list_concat(string_split(flat, chr(10)), list_transform(regexp_split_to_array(flat, '\n *\n'), lambda x: replace(x, chr(10), ' '))), [replace(flat, chr(10), ' ')]) AS units
  FROM d),
e AS (SELECT r, unnest(units) AS unit, unnest(range(0, len(units))) AS i FROM u),
w AS (SELECT r, i, list_filter(string_split(unit, ' '), lambda x: x <> '') AS w FROM e),
g AS (SELECT r, i, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS grams FROM w WHERE len(w) > 1),
m AS (
  SELECT r, i, t.name, t.family, 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.grams) BETWEEN lo AND hi
  WHERE 100 * 2 * len(list_intersect(g.grams, t.grams)) >= 80 * (len(g.grams) + len(t.grams))
    AND len(list_intersect(g.grams, t.must)) = len(t.must) AND len(list_intersect(g.grams, t.never)) = 0),
best AS (SELECT r, i, name, dice, row_number() OVER (PARTITION BY r ORDER BY family, dice DESC, name, i) AS o FROM m)
SELECT d.doc_id, len(list_filter(string_split(flat, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_lines, name AS license, round(dice, 6) AS dice, coalesce(i, -1)::BIGINT AS unit
FROM d LEFT JOIN best ON best.r = d.r AND o = 1
"""


ORACLES = {
    "op3_url_filters": _URL, "op5_decontamination": _DECONTAMINATION, "op6_warc": _WARC, "op7_jaccard_join": _JACCARD,
    "op9_substring_dedup": _REPEATS, "op10_license_scan": _license(), "op11_minhash_near_dedup": _MINHASH, "op12_phrase_collocation": _PHRASES,
}
