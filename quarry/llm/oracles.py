"""DuckDB SQL for the queries that SQL can state, over whole tables."""

from __future__ import annotations

from collections.abc import Mapping

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REVISITS = r"""
WITH p AS (SELECT page_id, url, md5(html) AS digest, unnest([0, 1, 2, 3, 4]) AS k, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest FROM pages),
f AS (SELECT *, k = 0 OR (k = 3 AND page_id % 4 = 0) AS is_full FROM p),
s AS (SELECT page_id * 5 + k AS record_id, page_id + k * 7 AS time, CASE WHEN is_full THEN 'response' ELSE 'revisit' END AS kind, is_full, k, page_id,
    CASE k WHEN 1 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail' WHEN 2 THEN replace(url, 'http://', 'https://') WHEN 3 THEN upper(host) || rest WHEN 4 THEN host || upper(rest) ELSE url END AS spelled,
    CASE WHEN k IN (0, 1, 4) THEN substr(digest, 1, 12) WHEN is_full THEN 'v2' WHEN k = 2 AND page_id % 5 = 0 THEN 'old' END AS etag,
    CASE WHEN is_full OR k = 2 THEN 'day ' || CAST(page_id % 400 AS VARCHAR) END AS modified,
    CASE WHEN is_full OR k = 3 THEN digest END AS digest FROM f),
c1 AS (SELECT *, regexp_replace(trim(spelled), '#.*$', '') AS whole FROM s),
c2 AS (SELECT *, regexp_replace(whole, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c1),
c3 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), CASE WHEN starts_with(lower(whole), 'https://') THEN ':443$' ELSE ':80$' END, '') AS site, regexp_replace(bare, '^[^/?]*', '') AS tail FROM c2),
c4 AS (SELECT *, list_transform(list_sort(list_transform(list_filter(string_split(regexp_replace(tail, '^[^?]*\??', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)=')), lambda x, i: {'n': split_part(x, '=', 1), 'i': i, 'x': x})), lambda x: x.x) AS given FROM c3),
c AS (SELECT *, CASE WHEN site <> '' THEN site || CASE WHEN regexp_extract(tail, '^[^?]*') = '' THEN '/' ELSE regexp_extract(tail, '^[^?]*') END || CASE WHEN len(given) > 0 THEN '?' || array_to_string(given, '&') ELSE '' END END AS canonical FROM c4),
j AS (SELECT c.*, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER w AS b_id, last_value(CASE WHEN is_full THEN etag END IGNORE NULLS) OVER w AS b_etag,
    last_value(CASE WHEN is_full THEN modified END IGNORE NULLS) OVER w AS b_modified, last_value(CASE WHEN is_full THEN digest END IGNORE NULLS) OVER w AS b_digest, last_value(CASE WHEN is_full THEN page_id END IGNORE NULLS) OVER w AS b_page
    FROM c WINDOW w AS (PARTITION BY canonical ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN is_full THEN NULL WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN 'etag' WHEN modified IS NOT NULL AND b_modified IS NOT NULL THEN 'last-modified' WHEN digest IS NOT NULL AND b_digest IS NOT NULL THEN 'digest' END AS validator FROM j),
t AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN canonical IS NULL THEN 'no-url' WHEN b_id IS NULL THEN 'no-response' WHEN validator = 'etag' AND etag = b_etag OR validator = 'last-modified' AND modified = b_modified OR validator = 'digest' AND digest = b_digest THEN 'resolved' ELSE 'mismatch' END AS status FROM r)
SELECT record_id, canonical, kind, status, CASE WHEN status IN ('resolved', 'mismatch') THEN b_id END AS refers_to, validator,
  CASE status WHEN 'full' THEN 'content-type=text/html;date=' || CAST(page_id AS VARCHAR) || ';server=a'
    WHEN 'resolved' THEN 'content-type=text/html;date=' || CAST(page_id + k AS VARCHAR) || ';expires=' || CAST(k AS VARCHAR) || ';server=a' ELSE '' END AS headers FROM t
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS gram FROM p),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
x AS (SELECT DISTINCT doc_id, i + o AS at FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (gram) WHERE m.least < g.doc_id), (SELECT unnest(range(0, 13)) AS o)),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS at, unnest(w) AS word FROM d),
k AS (SELECT e.doc_id, count(x.at) AS n_removed, coalesce(string_agg(CASE WHEN x.at IS NULL THEN word END, ' ' ORDER BY e.at), '') AS kept FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.at = e.at GROUP BY e.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
f AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase FROM q),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM s CROSS JOIN (SELECT DISTINCT n FROM f)),
h AS (SELECT y.doc_id, y.i, f.n, f.item_id FROM y JOIN f ON f.phrase = y.phrase AND f.n = y.n),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def _hashed(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


#: One tree: levels until a single node is left, the runs of each level, and the way of each leaf. ``t``, ``r``, ``w``: names.
_TREE = """{t}(k, lvl, i, h, n) AS (SELECT k, 0, i, h, count(*) OVER (PARTITION BY k) FROM {leaves} UNION ALL SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {t} WHERE n > 1 GROUP BY k, lvl, i // 3, n),
{r} AS (SELECT k, lvl, i // 3 AS g, list(h ORDER BY i) AS hs FROM {t} WHERE n > 1 GROUP BY k, lvl, i // 3),
{w}(k, lvl, i, id, proof, fold) AS (SELECT k, 0, i, id, proof, fold FROM {ways} UNION ALL SELECT w.k, w.lvl + 1, w.i // 3, id, proof || array_to_string(hs[1:w.i % 3], '') || array_to_string(hs[w.i % 3 + 2:], ''),
  sha256(array_to_string(hs[1:w.i % 3], '') || fold || array_to_string(hs[w.i % 3 + 2:], '')) FROM {w} w JOIN {r} r ON r.k = w.k AND r.lvl = w.lvl AND r.g = w.i // 3)"""
MERKLE = f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(x AS UBIGINT) FOR x IN range(8)]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END)) AS crc),
e AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 2 = 0 AS changed FROM documents, c),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS k, {_hashed("text")} AS h, {_hashed("CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END")} AS odd FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
ow AS (SELECT *, '' AS proof, odd AS fold FROM o),
{_TREE.format(t="t", r="r", w="w", leaves="o", ways="ow")},
s AS (SELECT k AS source, h, row_number() OVER (ORDER BY k) - 1 AS i, '' AS k FROM t WHERE n = 1),
ends AS (SELECT w.* FROM w JOIN t ON t.k = w.k AND t.lvl = w.lvl AND t.i = w.i WHERE t.n = 1),
sw AS (SELECT '' AS k, s.i, ends.id, ends.proof, ends.fold FROM ends JOIN s ON s.source = ends.k),
{_TREE.format(t="st", r="sr", w="sv", leaves="s", ways="sw")},
root AS (SELECT h, lvl FROM st WHERE n = 1)
SELECT o.doc_id, o.h AS leaf, s.h AS subroot, root.h AS root, sha256(sv.proof) AS proof_sha256, sv.fold AS folded_root, sv.fold = root.h AS verified
FROM sv JOIN root ON root.lvl = sv.lvl JOIN o ON o.id = sv.id JOIN s ON s.source = o.k
"""

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND n >= 10),
x AS (SELECT c.*, l.n AS l, r.n AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.n AS HUGEINT) * r.n) AS score FROM c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM b WHERE k = 3) GROUP BY lang, phrase),
q AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2 WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) JOIN (SELECT lang, sum(n) AS n FROM g WHERE k = 1 GROUP BY lang) t USING (lang) WHERE rank <= 2000
"""


def mixing(targets: Mapping[str, Mapping[str, float]], fraction: float, rounds: int = 64, seed: int = 8) -> str:
    """Raking and rates as a chain of steps over the cells."""
    names = list(targets)
    parts = [
        r"""r AS (SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%% ') THEN 'marked' WHEN contains(text, '!! ') THEN 'shouting' WHEN contains(text, 'Licensed under') THEN 'licensed' ELSE 'prose' END AS topic,
      coalesce(length(text) - length(replace(replace(replace(text, ' ', ''), chr(9), ''), chr(10), '')), 0) + 1 AS tokens FROM documents)""",
        f"c AS (SELECT {', '.join(names)}, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY {', '.join(names)})",
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c)",
    ]
    for name, goal in targets.items():
        rows = ", ".join(f"('{value}', CAST({share!r} AS DOUBLE))" for value, share in goal.items())
        parts.append(f"o_{name} AS (SELECT {name} AS value, sum(weight) AS own FROM w0 GROUP BY {name})")
        parts.append(f"k_{name} AS (SELECT o.value, own, given FROM o_{name} o LEFT JOIN (VALUES {rows}) g(value, given) ON o.value IS NOT DISTINCT FROM g.value)")
        parts.append(f"g_{name} AS (SELECT value, CASE WHEN given IS NULL THEN own ELSE given / sum(given) OVER () * (1 - coalesce(sum(CASE WHEN given IS NULL THEN own ELSE 0 END) OVER (), 0)) END AS goal FROM k_{name})")
    last = 0
    for _ in range(rounds):
        for name in names:
            parts.append(f"w{last + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (weight), weight * goal / sum(weight) OVER (PARTITION BY w.{name}) AS weight FROM w{last} w JOIN g_{name} g ON g.value IS NOT DISTINCT FROM w.{name})")
            last += 1
    parts.append(f"s0 AS (SELECT *, weight / tokens AS ratio, row_number() OVER (ORDER BY weight / tokens DESC, tokens DESC) AS nth FROM w{last})")
    parts.append(f"s1 AS (SELECT *, {fraction} * sum(tokens) OVER () - sum(tokens) OVER (ORDER BY nth) + tokens AS give, sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over FROM s0)")
    parts.append("l AS (SELECT arg_min(give / over, nth) AS level FROM s1 WHERE over > 0 AND give / over * ratio <= 1)")
    parts.append("s2 AS (SELECT s1.*, coalesce(least(1.0, greatest(0.0, level * ratio)), 1.0) AS rate FROM s1 CROSS JOIN l)")
    same = " AND ".join(f"r.{n} IS NOT DISTINCT FROM s.{n}" for n in names)
    draw = f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}"
    return f"WITH {', '.join(parts)} SELECT r.doc_id, {', '.join('r.' + n for n in names)}, r.tokens, round(rate, 6) AS rate, {draw} < rate AS chosen FROM r JOIN s2 s ON {same}"
