"""DuckDB SQL of the text operators that SQL can express."""

from __future__ import annotations

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
k(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, CAST(i AS INTEGER), 1) AS own, substr(filter_order, 1, CAST(i AS INTEGER) - 1) AS earlier FROM o, range(1, 6) r(i)),
x AS (SELECT *, contains(fails, own) AS bad, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, s),
y AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: Damage by a table-driven CRC, then costs and edits of each suffix for every place a conversation can stand at, as ordered pairs.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(b))),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))),
  lambda a, x: xor(a >> 8, t.t[1 + (xor(a, x) & 255)])), 4294967295) % 20 AS fate FROM conversations, t),
r AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM c, (VALUES (1), (2)) v(k) WHERE fate <> 0 AND (k = 1 OR fate = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
  substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS (SELECT conv_id, n + 1 AS i, {'c': 0, 'e': ''} AS p0, {'c': 4, 'e': 'II'} AS p1, {'c': 2, 'e': 'I'} AS p2, {'c': 0, 'e': ''} AS p3 FROM s
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'c': 2 + b2.c, 'e': 'I' || b2.e}, {'c': 4 + b3.c, 'e': 'II' || b3.e}]), list_min([b1, {'c': 2 + b2.c, 'e': 'I' || b2.e}, {'c': 4 + b3.c, 'e': 'II' || b3.e}]),
    list_min([b2, {'c': 2 + b3.c, 'e': 'I' || b3.e}]), list_min([b3, {'c': 2 + b2.c, 'e': 'I' || b2.e}])
  FROM (SELECT p.conv_id, f.i,
      list_min([{'c': 3 + p0.c, 'e': 'D' || p0.e}, {'c': bar + 2 + m + p2.c, 'e': 'R' || p2.e}, {'c': bar + m + CASE initial WHEN 's' THEN p1.c WHEN 'u' THEN p2.c ELSE 1000000 END, 'e': 'K' || CASE initial WHEN 's' THEN p1.e ELSE p2.e END}]) AS b0,
      list_min([{'c': 3 + p1.c, 'e': 'D' || p1.e}, {'c': bar + 2 + m + p2.c, 'e': 'R' || p2.e}, {'c': bar + m + CASE initial WHEN 'u' THEN p2.c ELSE 1000000 END, 'e': 'K' || p2.e}]) AS b1,
      list_min([{'c': 3 + p2.c, 'e': 'D' || p2.e}, {'c': bar + 2 + m + p3.c, 'e': 'R' || p3.e}, {'c': bar + m + CASE initial WHEN 'a' THEN p3.c ELSE 1000000 END, 'e': 'K' || p3.e}]) AS b2,
      list_min([{'c': 3 + p3.c, 'e': 'D' || p3.e}, {'c': bar + 2 + m + p2.c, 'e': 'R' || p2.e}, {'c': bar + m + CASE initial WHEN 'u' THEN p2.c ELSE 1000000 END, 'e': 'K' || p2.e}]) AS b3
    FROM p JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS m, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS bar FROM f) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1)),
a AS (SELECT conv_id, p0.c AS cost, p0.e AS audit FROM p WHERE i = 1),
l AS (SELECT conv_id, audit, j, substr(audit, CAST(j AS INTEGER), 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)),
o AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS k FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
x AS (SELECT o.conv_id, o.j, o.e, o.k, f.role, f.text, f.initial, max(CASE WHEN o.k = 1 AND o.e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS s FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i WHERE o.e <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM x GROUP BY conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM q.conv_id
"""

ORACLES: dict[str, str] = {"op12_conversation_repair": CONVERSATION_REPAIR, "op11_exact_dedup": EXACT_DEDUP, "op13_filter_audit": FILTER_AUDIT}
