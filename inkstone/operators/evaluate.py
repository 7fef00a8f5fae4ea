"""Evaluation of signals on labelled data, slices, sampling and gates."""

from inkstone.operators import lexical  # noqa: F401  registers signals
from inkstone.plans.catalogue import PLANNED, query, relation

# Spark measures each text once and keeps the rows that all parts of a query read
relation("scored", "SELECT s.doc_id, s.signal, round(s.value, 9) AS score, l.quality AS label, l.toxic, d.lang, d.source, CASE WHEN t.n < 200 THEN 's' WHEN t.n < 1000 THEN 'm' ELSE 'l' END AS bucket FROM {signals} s JOIN {labels} l ON l.doc_id = s.doc_id JOIN {documents} d ON d.doc_id = s.doc_id JOIN {doc_totals} t ON t.doc_id = s.doc_id WHERE s.value IS NOT NULL",
    spark=f"""
SELECT x.doc_id, x.signal, round(x.value, 9) AS score, l.quality AS label, l.toxic, x.lang, x.source, CASE WHEN x.n < 200 THEN 's' WHEN x.n < 1000 THEN 'm' ELSE 'l' END AS bucket
FROM ({PLANNED["signals"].replace("SELECT doc_id,", "SELECT doc_id, lang, source, n,")}) x JOIN {{labels}} l ON l.doc_id = x.doc_id WHERE x.value IS NOT NULL""", written=True)


def score_bin(x: str) -> str:
    """A bin that grows with x, some thousands over all doubles: orders are taken within bins, offsets over bins, so that no task sorts a whole signal."""
    return f"CAST(floor(sign({x}) * ln(1 + abs({x}) * 1000) * 100) AS BIGINT)"


def auc(keys: str) -> str:
    """AUC for each group of keys, ties counted half; NULL for one class."""
    return f"""
WITH c AS (SELECT {keys}, {score_bin("score")} AS bin, score, count_if(label = 1) AS p, count_if(label = 0) AS n FROM {{scored}} GROUP BY {keys}, score),
w AS (SELECT {keys}, bin, p, n, sum(n) OVER (PARTITION BY {keys}, bin ORDER BY score) - n AS under FROM c),
b AS (SELECT {keys}, bin, sum(p) AS p, sum(n) AS n, sum(CAST(p AS DOUBLE) * (under + n / 2.0)) AS won FROM w GROUP BY {keys}, bin),
o AS (SELECT {keys}, p, n, won + CAST(p AS DOUBLE) * (sum(n) OVER (PARTITION BY {keys} ORDER BY bin) - n) AS won FROM b)
SELECT {keys}, CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n, CAST(sum(won) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0) AS DOUBLE) AS auc FROM o GROUP BY {keys}"""


relation("auc_by_signal", auc("signal"))
query("roc_auc_by_signal", "SELECT signal, p, n, round(CAST(auc AS DOUBLE), 6) AS auc, round(CAST(greatest(auc, 1 - auc) AS DOUBLE), 6) AS oriented FROM {auc_by_signal}")
relation("scored_bins", f"SELECT signal, doc_id, score, label, {score_bin('score')} AS bin FROM {{scored}}")
# Spark alone reads it: the exact median of a signal, from the counts of its bins and the one or two bins that it lies in
relation("score_medians", """
WITH c AS (SELECT signal, bin, score, count(*) AS n FROM {scored_bins} WHERE score IS NOT NULL GROUP BY signal, bin, score),
b AS (SELECT signal, bin, sum(n) AS n FROM c GROUP BY signal, bin),
o AS (SELECT signal, bin, n, sum(n) OVER (PARTITION BY signal ORDER BY bin) - n AS under, sum(n) OVER (PARTITION BY signal) AS total FROM b),
w AS (SELECT signal, bin, under, total FROM o WHERE under + n > (total - 1) div 2 AND under <= total div 2),
r AS (SELECT c.signal, c.score, w.total, w.under + sum(c.n) OVER (PARTITION BY c.signal, c.bin ORDER BY c.score) AS upto FROM c JOIN w ON w.signal = c.signal AND w.bin = c.bin)
SELECT signal, (min(CASE WHEN upto > (total - 1) div 2 THEN score END) + min(CASE WHEN upto > total div 2 THEN score END)) / 2 AS cutoff FROM r GROUP BY signal""")
relation("bin_counts", """
WITH b AS (SELECT signal, bin, count(*) AS n, sum(label) AS p FROM {scored_bins} GROUP BY signal, bin)
SELECT signal, bin, sum(n) OVER (w) - n AS n_above, sum(p) OVER (w) - p AS p_above, sum(n) OVER (PARTITION BY signal) AS n_all, sum(p) OVER (PARTITION BY signal) AS p_all FROM b WINDOW w AS (PARTITION BY signal ORDER BY bin DESC)""")
query("average_precision", """
WITH r AS (SELECT signal, bin, label, row_number() OVER w AS k, sum(label) OVER (PARTITION BY signal, bin ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM {scored_bins} WINDOW w AS (PARTITION BY signal, bin ORDER BY score DESC, doc_id))
SELECT r.signal, round(sum(CASE WHEN label = 1 THEN CAST(p_above + hits AS DOUBLE) / (n_above + k) ELSE 0 END) / nullif(sum(label), 0), 6) AS ap FROM r JOIN {bin_counts} b ON b.signal = r.signal AND b.bin = r.bin GROUP BY r.signal""")
relation("operating_points", """
WITH c AS (SELECT signal, bin, score, sum(label) AS p, sum(1 - label) AS n FROM {scored_bins} GROUP BY signal, bin, score),
s AS (SELECT signal, bin, score, sum(p) OVER w AS p, sum(n) OVER w AS n FROM c WINDOW w AS (PARTITION BY signal, bin ORDER BY score DESC))
SELECT s.signal, s.score, CAST(p_above + p AS DOUBLE) / p_all AS tpr, CAST(n_above - p_above + n AS DOUBLE) / (n_all - p_all) AS fpr FROM s JOIN {bin_counts} b ON b.signal = s.signal AND b.bin = s.bin""")
query("threshold_at_fpr", """
SELECT signal, round(min_by(score, k), 4) AS threshold, round(min_by(tpr, k), 6) AS tpr, round(min_by(fpr, k), 6) AS fpr FROM (SELECT signal, score, tpr, fpr, @ARR(-tpr;;fpr;;score)@ AS k FROM {operating_points} WHERE fpr <= 0.1) x GROUP BY signal""")
query("confusion_counts", "SELECT s.signal, count_if(flagged AND label = 1) AS tp, count_if(flagged AND label = 0) AS fp, count_if(NOT flagged AND label = 1) AS fn, count_if(NOT flagged AND label = 0) AS tn FROM (SELECT x.signal, label, CASE WHEN direction = 'lt' THEN score < threshold ELSE score > threshold END AS flagged FROM {scored} x JOIN {thresholds} t ON t.signal = x.signal) s GROUP BY s.signal")
_WILSON = "round(({p} + 1.9208 / n {s} 1.96 * sqrt({p} * (1 - {p}) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6)"
query("wilson_rates_by_lang", f"""
WITH r AS (SELECT d.lang, CAST(count(*) AS DOUBLE) AS n, avg(CAST(quality AS DOUBLE)) AS p FROM {{labels}} l JOIN {{documents}} d ON d.doc_id = l.doc_id GROUP BY d.lang)
SELECT lang, round(p, 6) AS rate, {_WILSON.format(p="p", s="-")} AS low, {_WILSON.format(p="p", s="+")} AS high FROM r""")
query("hanley_mcneil_cells", """
WITH q AS (SELECT signal, p, n, auc, auc / (2 - auc) AS q1, 2 * auc * auc / (1 + auc) AS q2 FROM (SELECT signal, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n, CAST(auc AS DOUBLE) AS auc FROM {auc_by_signal}) x)
SELECT signal, round(sqrt((auc * (1 - auc) + (p - 1) * (q1 - auc * auc) + (n - 1) * (q2 - auc * auc)) / (p * n)), 6) AS se FROM q""")
relation("auc_by_lang", auc("signal, lang"))
query("auc_crosstab", "SELECT signal, lang, p, n, round(CAST(auc AS DOUBLE), 6) AS auc FROM {auc_by_lang} WHERE p >= 3 AND n >= 3")
query("topic_leakage", """
WITH m AS (SELECT signal, avg(CAST(auc AS DOUBLE)) AS macro FROM {auc_by_lang} WHERE auc IS NOT NULL GROUP BY signal)
SELECT a.signal, round(CAST(a.auc AS DOUBLE), 6) AS pooled, round(m.macro, 6) AS macro, round(CAST(a.auc AS DOUBLE) - m.macro, 6) AS leakage FROM {auc_by_signal} a JOIN m ON m.signal = a.signal""")
query("simpson_check", """
SELECT a.signal, count_if((l.auc - 0.5) * (a.auc - 0.5) < 0) AS inverted, count(*) AS strata FROM {auc_by_signal} a JOIN {auc_by_lang} l ON l.signal = a.signal WHERE l.p >= 3 AND l.n >= 3 GROUP BY a.signal""")
query("pan_metrics", """
WITH x AS (SELECT l.quality AS y, 1 / (1 + exp(-(s.value - 5))) AS p FROM {signals} s JOIN {labels} l ON l.doc_id = s.doc_id WHERE s.signal = 'shannon_entropy'),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count_if(abs(p - 0.5) < 1e-9) AS undecided, count_if((p > 0.5) = (y = 1)) AS right_n, count_if(p > 0.5 AND y = 1) AS tp, count_if(p > 0.5 AND y = 0) AS fp, count_if(p <= 0.5 AND y = 1) AS fn, avg(power(p - y, 2)) AS brier FROM x)
SELECT round(1 - brier, 6) AS brier_complement, round((right_n + undecided * right_n / n) / n, 6) AS c_at_1, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 6) AS f05u FROM c""")
query("kappa", """
WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count_if(quality = toxic) AS agree, sum(quality) AS q, sum(toxic) AS t FROM {labels}),
e AS (SELECT n, agree / n AS po, (q / n) * (t / n) + (1 - q / n) * (1 - t / n) AS pe FROM c)
SELECT round(po, 6) AS observed, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM e""")
query("signal_correlations", """
SELECT a.signal AS a, b.signal AS b, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 4) AS pearson FROM {signals} a JOIN {signals} b ON a.doc_id = b.doc_id AND a.signal < b.signal WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.signal, b.signal""")
relation("value_ranks", f"""
WITH x AS (SELECT doc_id, signal, v, {score_bin("v")} AS bin FROM (SELECT doc_id, signal, round(value, 9) AS v FROM {{signals}} WHERE value IS NOT NULL) y),
b AS (SELECT signal, bin, count(*) AS n FROM x GROUP BY signal, bin),
o AS (SELECT signal, bin, sum(n) OVER (PARTITION BY signal ORDER BY bin) - n AS under, sum(n) OVER (PARTITION BY signal) AS n FROM b)
SELECT x.doc_id, x.signal, CAST(o.under + rank() OVER (PARTITION BY x.signal, x.bin ORDER BY x.v) AS BIGINT) AS rk, count(*) OVER (PARTITION BY x.signal, x.bin, x.v) AS ties, CAST(o.n AS BIGINT) AS n FROM x JOIN o ON o.signal = x.signal AND o.bin = x.bin""")
query("spearman", """
WITH r AS (SELECT doc_id, signal, CAST(rk + (ties - 1) / 2.0 AS DOUBLE) AS rk FROM {value_ranks})
SELECT a.signal AS a, b.signal AS b, round(covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0), 4) AS spearman FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.signal < b.signal GROUP BY a.signal, b.signal""")
query("conformal_p", """
WITH r AS (SELECT doc_id, bin, label, sum(label) OVER (PARTITION BY bin ORDER BY score DESC) AS own FROM {scored_bins} WHERE signal = 'shannon_entropy')
SELECT r.doc_id, round(CAST(1 + b.p_above + r.own AS DOUBLE) / (b.p_all + 1), 6) AS p FROM r JOIN {bin_counts} b ON b.bin = r.bin AND b.signal = 'shannon_entropy' WHERE r.label = 0""")
query("calibration_gates", "SELECT signal, p, n, auc > 0.5 AS polarity_ok, n >= 10 AS negatives_ok, CAST(auc AS DOUBLE) > 0.55 AND n >= 10 AS passed FROM {auc_by_signal}")
query("score_summary", "SELECT signal, label, count(*) AS n, round(avg(score), 4) AS mean, round(median(score), 4) AS middle, round(stddev_samp(score), 4) AS sd, round(@PCT(score;;0.1)@, 4) AS p10, round(@PCT(score;;0.9)@, 4) AS p90 FROM {scored} GROUP BY signal, label")
query("calibration_drift", """
WITH a AS (SELECT signal, avg(value) AS m FROM {signals} WHERE doc_id % 2 = 0 GROUP BY signal), b AS (SELECT signal, avg(value) AS m FROM {signals} WHERE doc_id % 2 = 1 GROUP BY signal)
SELECT a.signal, round((b.m - a.m) / nullif(abs(a.m), 0), 5) AS drift, abs(b.m - a.m) > 0.1 * abs(a.m) AS beyond FROM a FULL OUTER JOIN b ON a.signal = b.signal""")
query("macro_f1", """
WITH x AS (SELECT l.quality AS y, CASE WHEN s.score > 6 THEN 1 ELSE 0 END AS p FROM {scored} s JOIN {labels} l ON l.doc_id = s.doc_id WHERE s.signal = 'shannon_entropy')
SELECT round(1.0 * count_if(y = 1 AND p = 1) / nullif(count_if(y = 1 AND p = 1) + 0.5 * count_if(y <> p), 0), 6) AS f1_one, round(1.0 * count_if(y = 0 AND p = 0) / nullif(count_if(y = 0 AND p = 0) + 0.5 * count_if(y <> p), 0), 6) AS f1_zero FROM x""")
query("slices", "SELECT lang, bucket, label, count(*) AS n, round(avg(score), 4) AS mean FROM {scored} WHERE signal = 'mattr' GROUP BY GROUPING SETS ((), (lang), (bucket), (label), (lang, label))")
query("fairness_slice", "SELECT lang, count_if(quality = 1) AS pos, count_if(quality = 0) AS neg, CASE WHEN count_if(quality = 1) >= 5 AND count_if(quality = 0) >= 5 THEN round(avg(CAST(toxic AS DOUBLE)), 6) END AS rate FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY lang")
query("stratum_balance", "SELECT source, lang, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM {documents} GROUP BY source, lang")
query("stratified_shards", """
WITH x AS (SELECT doc_id, source, lang, md5(concat('7:', CAST(doc_id AS STRING))) AS h FROM {documents}),
b AS (SELECT source, lang, substr(h, 1, 3) AS bin, count(*) AS n FROM x GROUP BY source, lang, substr(h, 1, 3)),
o AS (SELECT source, lang, bin, sum(n) OVER (PARTITION BY source, lang ORDER BY bin) - n AS under FROM b)
SELECT x.doc_id, CAST((o.under + row_number() OVER (PARTITION BY x.source, x.lang, o.bin ORDER BY x.h, x.doc_id) - 1) % 4 AS BIGINT) AS shard FROM x JOIN o ON o.source IS NOT DISTINCT FROM x.source AND o.lang IS NOT DISTINCT FROM x.lang AND o.bin = substr(x.h, 1, 3)""")
query("stratified_subsample", "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat('s:', CAST(doc_id AS STRING))), doc_id) AS k FROM {labels}) x WHERE k <= 20")
query("length_stratified", """
WITH q AS (SELECT @PCT(n_chars;;0.25)@ AS a, @PCT(n_chars;;0.5)@ AS b, @PCT(n_chars;;0.75)@ AS c FROM {documents})
SELECT CASE WHEN n_chars < a THEN 0 WHEN n_chars < b THEN 1 WHEN n_chars < c THEN 2 ELSE 3 END AS stratum, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM {documents} CROSS JOIN q GROUP BY CASE WHEN n_chars < a THEN 0 WHEN n_chars < b THEN 1 WHEN n_chars < c THEN 2 ELSE 3 END""")
query("midrank_percentile", "SELECT doc_id, signal, round((rk - 1 + 0.5 * ties) / n, 6) AS percentile FROM {value_ranks}")
query("derived_seeds", "SELECT doc_id, @MOD32(concat('seed:', CAST(doc_id AS STRING));;1000003)@ AS seed FROM {documents}")
query("winner_by_least_auc", "SELECT lang, round(min(CAST(greatest(auc, 1 - auc) AS DOUBLE)), 6) AS worst FROM {auc_by_lang} WHERE auc IS NOT NULL GROUP BY lang")
query("polarity_verdict", "SELECT signal, count_if(auc > 0.55) AS up_n, count_if(auc < 0.45) AS down_n, CASE WHEN count_if(auc > 0.55) > 0 AND count_if(auc < 0.45) > 0 THEN 'mixed' WHEN count_if(auc > 0.55) > 0 THEN 'up' WHEN count_if(auc < 0.45) > 0 THEN 'down' ELSE 'flat' END AS verdict FROM {auc_by_lang} WHERE auc IS NOT NULL GROUP BY signal")
query("robustness_card", """
WITH a AS (SELECT signal, avg(CASE WHEN lang = 'en' THEN score END) AS base, avg(CASE WHEN lang = 'fr' THEN score END) AS moved FROM {scored} GROUP BY signal)
SELECT signal, round(moved / nullif(base, 0) - 1, 5) AS rel, CASE WHEN base IS NULL OR moved IS NULL THEN 'unknown' WHEN base * moved < 0 THEN 'inverted' WHEN abs(moved - base) <= 0.1 * abs(base) THEN 'stable' WHEN abs(moved - base) <= 0.3 * abs(base) THEN 'moderate' ELSE 'fragile' END AS class FROM a""")

# orientation of a signal, from twenty texts of each class on
query("signal_polarity", """
SELECT signal, p, n, CASE WHEN p < 20 OR n < 20 THEN 'too_few' WHEN auc > 0.55 THEN 'up' WHEN auc < 0.45 THEN 'down' ELSE 'flat' END AS polarity, CASE WHEN p >= 20 AND n >= 20 THEN round(CAST(greatest(auc, 1 - auc) AS DOUBLE), 6) END AS oriented FROM {auc_by_signal}""")
# the best share of positives found at three budgets of false positives
query("tpr_at_budgets", """
WITH b AS (SELECT * FROM (VALUES (0.01), (0.05), (0.1)) AS v(budget))
SELECT o.signal, CAST(b.budget AS DOUBLE) AS budget, round(max(CASE WHEN o.fpr <= b.budget THEN o.tpr ELSE 0 END), 6) AS tpr FROM {operating_points} o CROSS JOIN b GROUP BY o.signal, b.budget""")
# pairs of (source, language) groups by function-word distance: does a small distance tell one source? ties count half
_GROUP_RATES = "SELECT d.source, d.lang, f.word, coalesce(sum(w.c), 0) * 1.0 / max(d.n) AS rate FROM (SELECT source, lang, sum(n) AS n FROM {doc_totals} GROUP BY source, lang) d CROSS JOIN {function_words} f LEFT JOIN {doc_words} w ON w.source = d.source AND w.lang = d.lang AND w.word = f.word GROUP BY d.source, d.lang, f.word"
relation("group_rates", _GROUP_RATES, spark=_GROUP_RATES.replace("sum(n) AS n FROM {doc_totals}", "sum(c) AS n FROM {group_words}").replace("{doc_words}", "{group_words}"))
relation("group_pairs", "SELECT CASE WHEN a.source = b.source THEN 1 ELSE 0 END AS same, round(CAST(sum(abs(a.rate - b.rate)) AS DOUBLE), 9) AS l1 FROM {group_rates} a JOIN {group_rates} b ON b.word = a.word AND (a.source < b.source OR (a.source = b.source AND a.lang < b.lang)) GROUP BY a.source, a.lang, b.source, b.lang")
query("voice_pair_auc", """
WITH c AS (SELECT l1, count_if(same = 1) AS p, count_if(same = 0) AS n FROM {group_pairs} GROUP BY l1),
w AS (SELECT p, n, sum(n) OVER (ORDER BY l1 DESC) - n AS above FROM c)
SELECT CAST(sum(p) AS BIGINT) AS same_pairs, CAST(sum(n) AS BIGINT) AS other_pairs, round(CAST(sum(p * (above + n / 2.0)) AS DOUBLE) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0), 6) AS auc FROM w""")
# each signal by each other one, by least squares
query("signal_regressions", """
WITH m AS (SELECT a.signal AS target, b.signal AS feature, count(*) AS n, avg(a.value) AS ma, avg(b.value) AS mb, covar_pop(a.value, b.value) AS cab, var_pop(a.value) AS va, var_pop(b.value) AS vb
  FROM {signals} a JOIN {signals} b ON b.doc_id = a.doc_id AND b.signal <> a.signal WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.signal, b.signal)
SELECT target, feature, n, round(cab / nullif(vb, 0), 4) + 0.0 AS slope, round(ma - cab / nullif(vb, 0) * mb, 3) + 0.0 AS intercept, round(cab * cab / nullif(va * vb, 0), 5) AS r2 FROM m""")
# whole texts against their windows of 100 words: agreement of two measures of variety, from three windows on
query("segment_agreement", """
WITH w AS (SELECT doc_id, CAST(floor(pos / 100) AS BIGINT) AS win, count(DISTINCT word) AS kinds, count(*) AS n FROM {tokens} GROUP BY doc_id, CAST(floor(pos / 100) AS BIGINT)),
s AS (SELECT doc_id, count(*) AS windows, avg(CAST(kinds AS DOUBLE) / n) AS ttr FROM w WHERE n = 100 GROUP BY doc_id HAVING count(*) >= 3),
j AS (SELECT s.ttr, m.mattr FROM s JOIN {mattr} m ON m.doc_id = s.doc_id)
SELECT count(*) AS texts, round(corr(ttr, mattr), 5) AS pearson, round(avg(abs(ttr - mattr)), 5) AS mean_difference FROM j""")
