"""SQL for DuckDB of the corpus queries that SQL can express, by plain joins over all windows and shingles."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = r"""WITH p AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
 x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p, unnest(range(1, n - 11)) t(i)),
 m AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
 h AS (SELECT DISTINCT doc_id, j FROM x JOIN m USING (k), unnest(range(i, i + 13)) u(j) WHERE first < doc_id),
 t AS (SELECT doc_id, i, ws[i] AS word FROM p, unnest(range(1, n + 1)) t(i)),
 k AS (SELECT t.doc_id, count(h.j) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (h.j IS NULL) AS kept FROM t LEFT JOIN h ON h.doc_id = t.doc_id AND h.j = t.i GROUP BY 1)
 SELECT p.doc_id, n AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM p LEFT JOIN k USING (doc_id)"""

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
 b AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)),
 p AS (SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(ws[i:i + least(n, 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(n - 9, 1) + 1)) t(i) WHERE n > 0),
 x AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS k FROM d, (SELECT DISTINCT size FROM p) s, unnest(range(1, n - size + 2)) t(i)),
 o AS (SELECT x.doc_id, x.i, x.size, p.item_id FROM x JOIN p USING (size, k)),
 h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM o, unnest(range(i, i + size)) u(j) GROUP BY 1),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY 1)
 SELECT d.doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""

MINHASH = rf"""WITH RECURSIVE p AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM p, unnest(range(1, greatest(n - 4, 1) + 1)) t(i) WHERE n > 0),
 c AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
 e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 75 * (ca.size + cb.size - shared)),
 r AS (SELECT doc_id AS node, doc_id AS reach FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
 g AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
 SELECT p.doc_id, coalesce(size, 0) AS n_shingles, component_id, component_id = p.doc_id AS kept FROM p JOIN g ON g.node = p.doc_id LEFT JOIN c USING (doc_id)"""

RESAMPLE = rf"""WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
 one AS (SELECT b, v AS x FROM bits WHERE k = 8),
 d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
 e AS (SELECT ws, len(ws) AS n FROM (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)),
 g AS (SELECT unnest([1, 2, 3]) AS k),
 df AS (SELECT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS f, count(*) AS c FROM d, g, unnest(range(1, n - k + 2)) t(i) GROUP BY 1, 2),
 ef AS (SELECT array_to_string(ws[i:i + k - 1], ' ') AS f, count(*) AS c FROM e, g, unnest(range(1, n - k + 2)) t(i) GROUP BY 1),
 f AS (SELECT f, hex(encode(f)) AS h, strlen(f) AS n FROM (SELECT f FROM df UNION SELECT f FROM ef)),
 far AS (SELECT b, x AS v, 0 AS k FROM one UNION ALL SELECT 256, 4294967295, 0 UNION ALL SELECT far.b, xor(far.v >> 8, one.x), far.k + 1 FROM far JOIN one ON one.b = far.v & 255 WHERE far.k < (SELECT max(n) FROM f)),
 c AS (SELECT f.f, (xor(bit_xor(far.v), xor(any_value(z.v), 4294967295))) % 10000 AS bucket FROM f, unnest(range(0, f.n)) t(i), far, far z WHERE far.k = f.n - 1 - i AND far.b = ('0x' || h[2 * i + 1:2 * i + 2])::INT AND z.b = 256 AND z.k = f.n GROUP BY f.f),
 s AS (SELECT bucket, sum(df.c) AS s FROM df JOIN c USING (f) GROUP BY 1), t AS (SELECT bucket, sum(ef.c) AS t FROM ef JOIN c USING (f) GROUP BY 1),
 n AS (SELECT coalesce((SELECT sum(c) FROM df), 0)::DOUBLE AS s_all, coalesce((SELECT sum(c) FROM ef), 0)::DOUBLE AS t_all),
 gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM s FULL JOIN t USING (bucket), n),
 w AS (SELECT doc_id, sum(df.c) AS n_features, sum(gain * df.c)::BIGINT AS weight FROM df JOIN c USING (f) JOIN gain USING (bucket) GROUP BY 1),
 p AS (SELECT d.doc_id, d.n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w ON w.doc_id IS NOT DISTINCT FROM d.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= 20 AND doc_id IS NOT NULL) AS many FROM p)
 SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND doc_id IS NOT NULL AND place <= 5 * many // 100 THEN place END AS rank FROM r"""

AUDIT = r"""WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 d AS (SELECT part, doc_id, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM t),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS pos, list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 r AS (SELECT part, filter_order, step, pos, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN here AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, fails[pos] AS here, len(list_filter(before, lambda k: fails[k])) > 0 AS earlier FROM c, s) GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, pos))::BIGINT AS shapley FROM r"""

JACCARD = rf"""WITH RECURSIVE p AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM p, unnest(range(1, greatest(n - 2, 1) + 1)) t(i) WHERE n > 0),
 c AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
 e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 90 * (ca.size + cb.size - shared)),
 r AS (SELECT doc_id AS node, doc_id AS reach FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
 g AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
 SELECT p.doc_id, coalesce(size, 0) AS n_shingles, component_id FROM p JOIN g ON g.node = p.doc_id LEFT JOIN c USING (doc_id)"""
