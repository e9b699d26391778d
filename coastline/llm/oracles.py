"""SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from coastline.llm import licenses
from coastline.llm.common import UPPER

_LOW = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

LEAKS = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM documents),
dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
dw AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dk)),
hit AS (SELECT doc_id, p, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _crc32(text: str) -> str:
    """The unsigned checksum of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {bits}))"


PREFIX_TRIE = f"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, chars
  FROM (SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, c - c % 100 AS base, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
taken AS (SELECT ids.c, o.pos, digest, chars FROM ids JOIN o ON o.c = ids.base AND o.pos < h),
k AS (SELECT ids.c, h, count(taken.c) AS k FROM ids LEFT JOIN taken ON taken.c = ids.c GROUP BY ids.c, h),
r AS (SELECT * FROM taken UNION ALL SELECT o.c, pos - h + k, digest, chars FROM o JOIN k ON k.c = o.c WHERE pos >= h),
p AS (
  SELECT c, pos + 1 AS d, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos)) AS node, chars FROM r
  UNION ALL SELECT c, 0, '', 0 FROM ids),
linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
n AS (
  SELECT d, node, min(c) AS c, count(*) AS n_convs, min(chars) AS chars, min(parent) AS parent, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY d, node),
kids AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM n LEFT JOIN kids ON kids.parent = n.node),
sums AS (SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY p.node)
SELECT CAST(w.c AS BIGINT) AS conv_id, CAST(w.d AS BIGINT) AS depth, CAST(up.c AS BIGINT) AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN sums ON sums.node = w.node LEFT JOIN n up ON up.node = w.parent
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: A run of period q repeats a word five or more times in a row at the distance q, so that pairs of equal runs of five words show it.
RUNS = f"""
WITH h AS (SELECT doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
a AS (SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS five FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i),
runs AS (
  SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
least AS (SELECT doc_id, start, length, min(q) AS q FROM runs GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM least),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS t, min_by({{'s': start, 'n': length, 'q': q}}, [-length, start, q]) AS top FROM least GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.n AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period, CAST(1000 * top.n // top.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(per.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": NEAR_DUPLICATES, "op6_decontamination": LEAKS, "op10_license_scan": licenses.oracle_sql(), "op11_prefix_trie": PREFIX_TRIE, "op12_line_dedup": LINES, "op13_periodic_runs": RUNS}
