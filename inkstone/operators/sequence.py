"""Window and sequence analytics, periods and streams of numbers (events stand for injected series)."""

from inkstone.plans.catalogue import query, relation

relation("series", "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM {events}")
query("series_stats_by_user", """
WITH m AS (SELECT user_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM {series} GROUP BY user_id)
SELECT s.user_id, max(n) AS n, round(max(mean), 5) AS mean, round(max(sd), 5) AS sd, round(avg(power((value - mean) / nullif(sd, 0), 3)), 4) AS skew, round(avg(power((value - mean) / nullif(sd, 0), 4)) - 3, 4) AS excess_kurtosis FROM {series} s JOIN m ON m.user_id = s.user_id GROUP BY s.user_id""")
query("series_autocorrelation", """
WITH m AS (SELECT user_id, avg(value) AS mean FROM {series} GROUP BY user_id),
c AS (SELECT s.user_id, s.t, value - mean AS d FROM {series} s JOIN m ON m.user_id = s.user_id), l AS (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY t) AS p FROM c)
SELECT user_id, round(sum(d * p) / nullif(sum(d * d), 0), 5) AS acf1 FROM l GROUP BY user_id""")
query("series_delta_entropy", """
WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM {series}), r AS (SELECT user_id, min(d) AS lo, max(d) AS hi FROM d WHERE d IS NOT NULL GROUP BY user_id),
b AS (SELECT d.user_id, least(CAST(floor((d - lo) / nullif(hi - lo, 0) * 10) AS BIGINT), 9) AS bin FROM d JOIN r ON r.user_id = d.user_id WHERE d IS NOT NULL AND hi > lo),
c AS (SELECT user_id, bin, count(*) AS c FROM b GROUP BY user_id, bin), n AS (SELECT user_id, sum(c) AS n FROM c GROUP BY user_id)
SELECT c.user_id, round(-sum(c / n * log2(c / n)) + 0.0, 5) AS bits FROM c JOIN n ON n.user_id = c.user_id GROUP BY c.user_id""")
query("series_acceleration", """
WITH d AS (SELECT user_id, t, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM {series}), a AS (SELECT user_id, d, d - lag(d) OVER (PARTITION BY user_id ORDER BY t) AS a FROM d)
SELECT user_id, round(avg(d), 5) AS mean_delta, round(avg(abs(a)), 5) AS mean_abs_acceleration FROM a GROUP BY user_id""")
query("ordinal_entropy", """
WITH w AS (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS y, lead(value, 2) OVER (PARTITION BY user_id ORDER BY t) AS z FROM {series}),
p AS (SELECT user_id, concat(CASE WHEN x <= y THEN '1' ELSE '0' END, CASE WHEN y <= z THEN '1' ELSE '0' END, CASE WHEN x <= z THEN '1' ELSE '0' END) AS shape FROM w WHERE z IS NOT NULL),
c AS (SELECT user_id, shape, count(*) AS c FROM p GROUP BY user_id, shape), n AS (SELECT user_id, sum(c) AS n FROM c GROUP BY user_id)
SELECT c.user_id, round(-sum(c / n * log2(c / n)) + 0.0, 5) AS bits FROM c JOIN n ON n.user_id = c.user_id GROUP BY c.user_id""")
query("embedding_trajectory", """
WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM (SELECT DISTINCT vec_id FROM {unit_vectors}) x),
c AS (SELECT o.vec_id, o.k, sum(a.x * b.x) AS cosine FROM o JOIN o p ON p.k = o.k - 1 JOIN {unit_vectors} a ON a.vec_id = o.vec_id JOIN {unit_vectors} b ON b.vec_id = p.vec_id AND b.dim = a.dim GROUP BY o.vec_id, o.k)
SELECT count(*) AS steps, round(avg(cosine), 5) AS mean_cosine, round(stddev_samp(cosine), 5) AS sd, round(regr_slope(cosine, CAST(k AS DOUBLE)), 7) AS slope FROM c""")
query("boundary_detection", """
WITH s AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY snum) AS k FROM {sent_words}), d AS (SELECT doc_id, k, abs(w - lag(w) OVER (PARTITION BY doc_id ORDER BY k)) AS d FROM s),
m AS (SELECT doc_id, median(d) AS med FROM d WHERE d IS NOT NULL GROUP BY doc_id), a AS (SELECT d.doc_id, median(abs(d.d - m.med)) AS mad FROM d JOIN m ON m.doc_id = d.doc_id WHERE d IS NOT NULL GROUP BY d.doc_id),
p AS (SELECT doc_id, k, d, coalesce(lag(d) OVER (PARTITION BY doc_id ORDER BY k), -1) AS before_d, coalesce(lead(d) OVER (PARTITION BY doc_id ORDER BY k), -1) AS after_d FROM d WHERE d IS NOT NULL)
SELECT p.doc_id, count(*) AS peaks FROM p JOIN m ON m.doc_id = p.doc_id JOIN a ON a.doc_id = p.doc_id WHERE p.d >= before_d AND p.d >= after_d AND ((a.mad > 0 AND p.d > med + 2.5 * a.mad) OR (a.mad = 0 AND p.d > med)) GROUP BY p.doc_id""")
query("hot_zones", """
WITH f AS (SELECT user_id, t, CASE WHEN value > avg(value) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS hot FROM {series}), g AS (SELECT user_id, t, hot, t - row_number() OVER (PARTITION BY user_id, hot ORDER BY t) AS island FROM f),
z AS (SELECT user_id, island, min(t) AS start_t, count(*) AS n FROM g WHERE hot = 1 GROUP BY user_id, island)
SELECT user_id, start_t, n FROM z WHERE n >= 3""")
query("value_drift_by_month", """
WITH p AS (SELECT @MONTH(ts)@ AS period, event_type, avg(value) AS m FROM {events} GROUP BY @MONTH(ts)@, event_type HAVING count(*) >= 2)
SELECT event_type, count(*) AS periods, round(stddev_samp(m) / nullif(abs(avg(m)), 0), 5) AS cv FROM p GROUP BY event_type""")
query("period_grouping", "SELECT @MONTH(o_orderdate)@ AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY @MONTH(o_orderdate)@ HAVING count(*) >= 2")
query("burst_sessions", """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN @EPOCH(ts)@ - lag(@EPOCH(ts)@) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM {events}),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session""")
query("draft_trajectory", """
WITH d AS (SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM {conversations}),
a AS (SELECT conv_id, count(d) AS steps, max(abs(d)) AS most, avg(abs(d)) AS mean, sum(d) AS net FROM d GROUP BY conv_id)
SELECT conv_id, steps, CASE WHEN steps = 0 THEN 'unknown' WHEN most <= 20 THEN 'stable' WHEN most >= 2 * mean THEN 'sudden_shift' ELSE 'gradual_drift' END AS trajectory FROM a""")
query("turn_transitions", """
WITH t AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM {conversations})
SELECT role, nxt, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY role, nxt""")
query("skeleton_terciles", """
WITH s AS (SELECT doc_id, snum, w, row_number() OVER (PARTITION BY doc_id ORDER BY w, snum) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {sent_words}),
c AS (SELECT doc_id, max(CASE WHEN k = CAST(floor(n / 3.0) AS BIGINT) + 1 THEN w END) AS lo, max(CASE WHEN k = least(CAST(floor(2 * n / 3.0) AS BIGINT) + 1, n) THEN w END) AS hi FROM s GROUP BY doc_id)
SELECT s.doc_id, count_if(w < lo) AS short_n, count_if(w >= lo AND w < hi) AS mid_n, count_if(w >= hi) AS long_n FROM s JOIN c ON c.doc_id = s.doc_id GROUP BY s.doc_id""")
query("paraphrase_decay", """
WITH b AS (SELECT conv_id, turn, length(text) AS v, first_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS base FROM {conversations}),
r AS (SELECT conv_id, turn, abs(v - base) * 1.0 / nullif(base, 0) AS rel FROM b), m AS (SELECT conv_id, rel, lag(rel) OVER (PARTITION BY conv_id ORDER BY turn) AS before_rel FROM r)
SELECT conv_id, bool_and(before_rel IS NULL OR rel >= before_rel - 1e-12) AS monotone, round(max(rel), 5) AS most FROM m GROUP BY conv_id""")

# drafts of one conversation in order: each turn with every earlier one by the words that they share; its best earlier turn, and how many tie
relation("turn_words", "SELECT DISTINCT conv_id, turn, word FROM {chat_tokens}")
relation("turn_sizes", "SELECT conv_id, turn, count(*) AS n FROM {turn_words} GROUP BY conv_id, turn")
query("draft_best_pairs", """
WITH s AS (SELECT a.conv_id, a.turn AS earlier, b.turn AS later, count(*) AS common FROM {turn_words} a JOIN {turn_words} b ON b.conv_id = a.conv_id AND b.word = a.word AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn),
j AS (SELECT s.conv_id, s.earlier, s.later, round(CAST(common AS DOUBLE) / (x.n + y.n - common), 9) AS jaccard FROM s JOIN {turn_sizes} x ON x.conv_id = s.conv_id AND x.turn = s.earlier JOIN {turn_sizes} y ON y.conv_id = s.conv_id AND y.turn = s.later),
r AS (SELECT conv_id, later, earlier, jaccard, rank() OVER (PARTITION BY conv_id, later ORDER BY jaccard DESC) AS k FROM j)
SELECT conv_id, later, min(earlier) AS best, round(max(jaccard), 6) AS jaccard, count(*) AS ties FROM r WHERE k = 1 GROUP BY conv_id, later""")
# a turn against the one before: what has changed
query("turn_deltas", """
WITH m AS (SELECT conv_id, turn, count(*) AS words, count(DISTINCT word) AS kinds FROM {chat_tokens} GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, b.words - a.words AS d_words, b.kinds - a.kinds AS d_kinds, round(CAST(b.kinds AS DOUBLE) / b.words - CAST(a.kinds AS DOUBLE) / a.words, 6) AS d_ratio FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
# the arc of a work over its ordered labels (events stand for paragraphs): where it opens, how often a label follows itself, how much one label holds
query("label_arcs", """
WITH o AS (SELECT user_id AS work, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events})
SELECT work, min(CASE WHEN k = 1 THEN label END) AS opening, count(*) AS labels, count(DISTINCT label) AS kinds, count_if(nxt IS NOT NULL) AS steps, round(CAST(count_if(nxt = label) AS DOUBLE) / nullif(count_if(nxt IS NOT NULL), 0), 6) AS stay_rate FROM o GROUP BY work""")
query("label_transitions", """
WITH o AS (SELECT user_id, event_type AS label, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}),
c AS (SELECT label, nxt, count(*) AS n FROM o WHERE nxt IS NOT NULL GROUP BY label, nxt), t AS (SELECT label, sum(n) AS n FROM c GROUP BY label)
SELECT c.label, c.nxt AS next_label, c.n, round(CAST(c.n AS DOUBLE) / t.n, 6) AS rate FROM c JOIN t ON t.label = c.label""")
