"""Operators over tables of judgements and of injected series: labels and scores come as rows, no model is called.

Here `events` stands in for judgements: user_id is the work, event_type the signal, value what was observed. Vectors stand
in for series of log-probabilities by position (dim).
"""

from inkstone.functions.lexicons import CLAIM_BOOSTERS, CLAIM_HEDGES, CLAIM_STIPULATIONS
from inkstone.plans.catalogue import query, relation


def phrases(words) -> str:
    """A pattern for any of words between characters that are no letters, digits or underscores."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"


relation("judged", "SELECT event_id, user_id AS work, event_type AS signal, value AS observed, ts, user_id % 2 AS side FROM {events} WHERE value IS NOT NULL")
# reference means of both classes by signal: a row per signal
relation("class_means", "SELECT signal, avg(CASE WHEN side = 0 THEN observed END) AS low, avg(CASE WHEN side = 1 THEN observed END) AS high FROM {judged} GROUP BY signal")
relation("contributions", """
WITH o AS (SELECT work, signal, avg(observed) AS v FROM {judged} GROUP BY work, signal)
SELECT o.work, o.signal, o.v, (o.v - m.low) / nullif(m.high - m.low, 0) AS part FROM o JOIN {class_means} m ON m.signal = o.signal""")
query("decision_contributions", "SELECT work, signal, round(v, 6) AS observed, round(part, 4) AS contribution, CASE WHEN part IS NULL THEN 'none' WHEN part > 0.5 THEN 'high' WHEN part < 0.5 THEN 'low' ELSE 'middle' END AS side FROM {contributions}")
query("decision_bundles", """
SELECT work, count(*) AS signals, count(part) AS used, round(avg(part), 4) AS bundle, count_if(part > 0.5) AS above FROM {contributions} GROUP BY work""")
query("decision_preflag", """
SELECT work, CASE WHEN count(part) < 3 THEN 'too_few' WHEN count_if(part > 0.5) = count(part) THEN 'all_high' WHEN count_if(part < 0.5) = count(part) THEN 'all_low' ELSE 'mixed' END AS flag FROM {contributions} GROUP BY work""")
query("segment_aggregates", """
WITH s AS (SELECT work, @MONTH(ts)@ AS segment, signal, count(*) AS n, avg(observed) AS mean, count_if(observed > 50) AS over FROM {judged} GROUP BY work, @MONTH(ts)@, signal)
SELECT signal, count(*) AS segments, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 5) AS mean_of_segments, round(avg(CASE WHEN over > 0 THEN 1.0 ELSE 0.0 END), 6) AS prevalence FROM s GROUP BY signal""")
query("segment_modes", """
WITH c AS (SELECT work, signal, count(*) AS n FROM {judged} GROUP BY work, signal),
k AS (SELECT work, signal, n, row_number() OVER (PARTITION BY work ORDER BY n DESC, signal) AS k FROM c)
SELECT work, signal AS mode, n FROM k WHERE k = 1""")
query("pattern_tally", """
WITH t AS (SELECT signal, count(*) AS n, count(DISTINCT work) AS works FROM {judged} GROUP BY signal), a AS (SELECT count(*) AS n, count(DISTINCT work) AS works FROM {judged})
SELECT t.signal, t.n, t.works, round(t.n * 1.0 / a.n, 6) AS share, round(t.works * 1.0 / a.works, 6) AS share_of_works FROM t CROSS JOIN a""")
query("axis_coverage", """
SELECT signal AS axis, count_if(observed >= 60) AS present, count_if(observed >= 30 AND observed < 60) AS partial, count_if(observed < 30) AS absent FROM {judged} GROUP BY signal""")
# In document order at most two pairs a question, of those at most five a work; what falls away is shown as such.
query("position_pairs", """
WITH p AS (SELECT work, signal AS question, event_id AS a, ts, lead(event_id) OVER (PARTITION BY work, signal ORDER BY ts, event_id) AS b FROM {judged}),
q AS (SELECT work, question, a, b, ts, row_number() OVER (PARTITION BY work, question ORDER BY ts, a) AS k FROM p WHERE b IS NOT NULL),
w AS (SELECT work, question, a, b, k, sum(CASE WHEN k <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY ts, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j FROM q)
SELECT work, question, a, b, CASE WHEN k <= 2 AND j <= 5 THEN 'kept' WHEN k > 2 THEN 'question_cap' ELSE 'work_cap' END AS state FROM w""")

# Sampling curvature: what a position would give (mean and variance over its label's vectors) against what it gave.
relation("positions", "SELECT label, dim, avg(x) AS mu, var_pop(x) AS spread FROM {vector_values} GROUP BY label, dim")
query("sampling_curvature", """
SELECT v.vec_id, count(*) AS n, round(CASE WHEN sum(p.spread) > 1e-12 THEN (sum(v.x) - sum(p.mu)) / sqrt(sum(p.spread)) END, 5) AS curvature FROM {vector_values} v JOIN {positions} p ON p.label = v.label AND p.dim = v.dim GROUP BY v.vec_id""")
# Two-model ratio: a scorer's mean loss over the mean cross loss of scorer and observer (here the label's mean vector).
query("two_model_ratio", """
SELECT v.vec_id, round(avg(v.x * v.x) / nullif(avg(abs(v.x * p.mu)), 0), 4) AS ratio FROM {vector_values} v JOIN {positions} p ON p.label = v.label AND p.dim = v.dim GROUP BY v.vec_id""")
# Green-list test with each pair of words once; a pair is green if its keyed hash falls into a quarter.
query("green_list_z", """
WITH p AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {tokens}),
e AS (SELECT DISTINCT doc_id, before, word FROM p WHERE before IS NOT NULL),
g AS (SELECT doc_id, count(*) AS t, count_if(@MOD32(concat('key:', before, ':', word);;4)@ = 0) AS green FROM e GROUP BY doc_id)
SELECT doc_id, t, green, round(green * 1.0 / t, 6) AS share, round((green - 0.25 * t) / sqrt(t * 0.1875), 5) AS z FROM g""")

# Certainty of claims against their support. Sentences stand in for claims, their first word for the topic; a number is
# taken as support, a giving of reasons as a gesture. A claim that overstates is defended by a stipulation of its own or by
# another supported claim of its topic.
relation("claims", rf"""
WITH s AS (SELECT doc_id, snum, lower(sent) AS sent, @FIRST(lower(sent);;[a-z']+)@ AS topic FROM {{sents}})
SELECT doc_id, snum, topic, sent,
  CASE WHEN @MATCH(sent;;{phrases(CLAIM_HEDGES)})@ THEN CASE WHEN @MATCH(sent;;{phrases(CLAIM_BOOSTERS)})@ THEN 'measured' ELSE 'tentative' END ELSE 'assertive' END AS certainty,
  CASE WHEN @MATCH(sent;;[0-9])@ THEN 'substantiated' WHEN @MATCH(sent;;{phrases(("because", "since", "therefore"))})@ THEN 'gestured' ELSE 'none' END AS support FROM s""")
relation("aligned_claims", f"""
WITH a AS (SELECT doc_id, snum, topic, certainty, support, @MATCH(sent;;{'|'.join(CLAIM_STIPULATIONS)})@ AS stipulated, max(CASE WHEN support = 'substantiated' AND topic <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, topic) AS elsewhere,
  CASE WHEN certainty = 'assertive' AND support = 'none' THEN 'overclaim' WHEN certainty = 'tentative' AND support = 'substantiated' THEN 'underclaim' ELSE 'aligned' END AS pairing FROM {{claims}}),
d AS (SELECT doc_id, snum, certainty, support, pairing, CASE WHEN pairing <> 'overclaim' THEN 'none' WHEN stipulated THEN 'defended_stipulated' WHEN elsewhere = 1 THEN 'defended_elsewhere' ELSE 'none' END AS defence FROM a)
SELECT doc_id, snum, certainty, support, defence, CASE WHEN defence <> 'none' THEN 'aligned' ELSE pairing END AS alignment FROM d""")
query("certainty_calibration", "SELECT doc_id, count(*) AS claims, count_if(alignment = 'overclaim') AS overclaims, count_if(alignment = 'underclaim') AS underclaims, count_if(defence <> 'none') AS defended FROM {aligned_claims} GROUP BY doc_id")
query("certainty_crosstab", "SELECT certainty, support, defence, alignment, count(*) AS n FROM {aligned_claims} GROUP BY certainty, support, defence, alignment")

# Rewriting invariance: words of a turn against those of the turn after it, taken as its rewrite.
query("rewriting_overlap", """
WITH w AS (SELECT DISTINCT conv_id, turn, word FROM {chat_tokens}),
n AS (SELECT conv_id, turn, count(*) AS n FROM w GROUP BY conv_id, turn),
b AS (SELECT x.conv_id, x.turn, count(*) AS both FROM w x JOIN w y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 AND y.word = x.word GROUP BY x.conv_id, x.turn)
SELECT p.conv_id, p.turn, round(1 - coalesce(b.both, 0) * 1.0 / (p.n + q.n - coalesce(b.both, 0)), 6) AS distance FROM n p JOIN n q ON q.conv_id = p.conv_id AND q.turn = p.turn + 1 LEFT JOIN b ON b.conv_id = p.conv_id AND b.turn = p.turn""")
