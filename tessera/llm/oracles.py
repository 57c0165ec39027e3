"""DuckDB SQL that must give the rows of the queries, where SQL can express them."""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
    FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP3 = r"""
WITH n AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
gram AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM n, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT doc_id, p, k, item_id FROM gram JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM occ) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

OP4 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('mix-1:' || doc_id) AS draw FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY draw, doc_id) AS row FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, (3 * source_size)::DOUBLE / (1 + (rank - 1) % 3)::DOUBLE AS level,
    (SELECT coalesce(sum(size), 0)::BIGINT FROM d) AS budget FROM s),
f AS (SELECT *, 3 * (coalesce(sum(source_size) OVER e, 0))::BIGINT
        + level * (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0))::BIGINT <= budget AS is_full
    FROM w WINDOW e AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * (
        (budget - (SELECT coalesce(sum(3 * source_size), 0)::BIGINT FROM f WHERE is_full))::DOUBLE
        / (SELECT sum(weight)::BIGINT FROM f WHERE NOT is_full)::DOUBLE) END AS target FROM f),
q AS (SELECT row, doc_id, size, source_size, target, rank, weight, budget,
    sum(size) OVER (PARTITION BY rank ORDER BY row) AS sent FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT row, size, rank, copy, budget, (copy * source_size + sent)::DOUBLE / weight::DOUBLE AS finish
    FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 OR copy = 0),
o AS (SELECT row, size, budget, sum(size) OVER (ORDER BY finish, rank, copy, row ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT row, sum(size) AS taken FROM o WHERE total <= budget GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (row)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
two AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
s AS (SELECT g.* FROM g JOIN two USING (t)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT u AS id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
        sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90
        THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b,
    array_to_string(w[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
        ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
