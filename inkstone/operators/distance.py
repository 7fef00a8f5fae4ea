"""Baselines, distances and divergences (source or language stands for author or persona)."""

from inkstone.plans.catalogue import query, relation

query("signal_baseline", "SELECT d.source, s.signal, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM {signals} s JOIN {documents} d ON d.doc_id = s.doc_id WHERE value IS NOT NULL GROUP BY d.source, s.signal")
query("source_zscores", """
WITH b AS (SELECT signal, avg(value) AS m, stddev_samp(value) AS sd FROM {signals} WHERE value IS NOT NULL GROUP BY signal)
SELECT s.doc_id, s.signal, round((s.value - b.m) / nullif(b.sd, 0), 4) AS z FROM {signals} s JOIN b ON b.signal = s.signal WHERE s.value IS NOT NULL""")
_MOST = """
WITH f AS (SELECT w.word, sum(c) AS n FROM {doc_words} w JOIN {function_words} f ON f.word = w.word GROUP BY w.word)
SELECT word, CAST(n AS BIGINT) AS n FROM f ORDER BY n DESC, word LIMIT 100"""
query("feature_selection", _MOST, spark=_MOST.replace("{doc_words}", "{group_words}"))
_RATES = """
SELECT d.source, f.word, coalesce(sum(w.c), 0) * 1.0 / max(d.n) AS rate FROM (SELECT source, sum(n) AS n FROM {doc_totals} GROUP BY source) d CROSS JOIN {function_words} f
LEFT JOIN {doc_words} w ON w.source = d.source AND w.word = f.word GROUP BY d.source, f.word"""
# words are counted by source once, where the texts lie, however often the rates are read
relation("function_rates", _RATES, spark=_RATES.replace("sum(n) AS n FROM {doc_totals}", "sum(c) AS n FROM {group_words}").replace("{doc_words}", "{group_words}"))
relation("function_z", """
SELECT r.source, r.word, (r.rate - b.m) / b.sd AS z FROM {function_rates} r JOIN (SELECT word, avg(rate) AS m, stddev_samp(rate) AS sd FROM {function_rates} GROUP BY word) b ON b.word = r.word WHERE b.sd > 1e-12""")
query("burrows_delta_by_source", "SELECT source, round(avg(abs(z)), 5) AS delta, count(*) AS features FROM {function_z} GROUP BY source")
query("delta_pairs", "SELECT a.source AS a, b.source AS b, round(avg(abs(a.z - b.z)), 5) AS delta FROM {function_z} a JOIN {function_z} b ON a.word = b.word AND a.source < b.source GROUP BY a.source, b.source")
query("cosine_to_centroid", """
WITH c AS (SELECT word, avg(rate) AS m FROM {function_rates} GROUP BY word)
SELECT r.source, round(1 - sum(r.rate * c.m) / (sqrt(sum(r.rate * r.rate)) * sqrt(sum(c.m * c.m))), 6) AS distance FROM {function_rates} r JOIN c ON c.word = r.word GROUP BY r.source""")
_LANG_DELTA = """, n AS (SELECT lang, sum(c) AS n FROM g GROUP BY lang),
top AS (SELECT gram FROM (SELECT gram, sum(c) AS c FROM g GROUP BY gram) x ORDER BY c DESC, gram LIMIT 200),
r AS (SELECT n.lang, t.gram, coalesce(g.c, 0) * 1.0 / n.n AS rate FROM n CROSS JOIN top t LEFT JOIN g ON g.lang = n.lang AND g.gram = t.gram),
b AS (SELECT gram, avg(rate) AS m, stddev_pop(rate) AS sd FROM r GROUP BY gram)
SELECT r.lang, round(avg(abs((r.rate - m) / nullif(sd, 0))), 5) AS delta FROM r JOIN b ON b.gram = r.gram GROUP BY r.lang"""
query("char_ngram_delta_by_lang", """
WITH g AS (SELECT lang, gram, count(*) AS c FROM {trigrams} GROUP BY lang, gram)""" + _LANG_DELTA, spark="\nWITH g AS (SELECT lang, gram, c FROM {trigram_counts})" + _LANG_DELTA)
relation("bigram_counts", """
WITH t AS (SELECT lang, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {tokens}) SELECT lang, concat(t.word, ' ', nxt) AS bigram, count(*) AS c FROM t JOIN {function_words} f ON f.word = t.word WHERE nxt IS NOT NULL GROUP BY lang, concat(t.word, ' ', nxt)""",
    spark="SELECT lang, concat(p.word, ' ', nxt) AS bigram, sum(c) AS c FROM {lang_pairs} p JOIN {function_words} f ON f.word = p.word GROUP BY lang, concat(p.word, ' ', nxt)")
_PAIR = """
WITH u AS (SELECT coalesce(a.bigram, b.bigram) AS bigram, coalesce(a.c, 0) + 1 AS ca, coalesce(b.c, 0) + 1 AS cb FROM (SELECT * FROM {bigram_counts} WHERE lang = 'en') a FULL OUTER JOIN (SELECT * FROM {bigram_counts} WHERE lang <> 'en' AND lang = 'de') b ON a.bigram = b.bigram),
s AS (SELECT sum(ca) AS ta, sum(cb) AS tb FROM u),
p AS (SELECT bigram, CAST(ca AS DOUBLE) / ta AS p, CAST(cb AS DOUBLE) / tb AS q FROM u CROSS JOIN s)"""
query("bigram_kl", _PAIR + """
SELECT 'en|de' AS pair, count(*) AS bigrams, round(sum(p * log2(p / q)), 6) AS kl, round(sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))), 6) AS js FROM p""")
query("bigram_kl_contributions", _PAIR + """
SELECT bigram, round(p * log2(p / q), 7) AS contribution FROM p ORDER BY round(abs(p * log2(p / q)), 9) DESC, bigram LIMIT 50""")
relation("ranked_words", "SELECT lang, word, c, rank() OVER (PARTITION BY lang ORDER BY c DESC) AS r FROM (SELECT t.lang, t.word, count(*) AS c FROM {tokens} t JOIN {function_words} f ON f.word = t.word WHERE lang IN ('en', 'fr') GROUP BY t.lang, t.word) x")
query("rank_turbulence", """
WITH a AS (SELECT word, r FROM {ranked_words} WHERE lang = 'en'), b AS (SELECT word, r FROM {ranked_words} WHERE lang = 'fr'),
k AS (SELECT (SELECT count(*) FROM a) AS k1, (SELECT count(*) FROM b) AS k2),
u AS (SELECT coalesce(a.word, b.word) AS word, a.r AS r1, b.r AS r2 FROM a FULL OUTER JOIN b ON a.word = b.word),
n AS (SELECT count(*) AS n FROM u),
x AS (SELECT u.word, coalesce(r1, k1 + (n - k1 + 1) / 2.0) AS r1, coalesce(r2, k2 + (n - k2 + 1) / 2.0) AS r2 FROM u CROSS JOIN k CROSS JOIN n),
s AS (SELECT sum(power(abs(power(1.0 / r1, 1.0 / 3) - power(1.0 / r2, 1.0 / 3)), 0.75)) AS top FROM x),
d AS (SELECT (SELECT sum(power(abs(power(1.0 / r, 1.0 / 3) - power(1.0 / (k2 + (k1 + 1) / 2.0), 1.0 / 3)), 0.75)) FROM a CROSS JOIN k) + (SELECT sum(power(abs(power(1.0 / r, 1.0 / 3) - power(1.0 / (k1 + (k2 + 1) / 2.0), 1.0 / 3)), 0.75)) FROM b CROSS JOIN k) AS bottom)
SELECT n.n AS vocabulary, round(CAST(top / bottom AS DOUBLE), 6) AS rtd FROM s CROSS JOIN d CROSS JOIN n""")
query("competition_ranks", "SELECT lang, word, c, r FROM {ranked_words}")
query("novelty_profile", """
WITH b AS (SELECT word, avg(rate) AS m, stddev_samp(rate) AS sd FROM {function_rates} WHERE source <> 'src0' GROUP BY word)
SELECT r.word, round((r.rate - m) / nullif(sd, 0), 5) AS z, b.m < 1e-12 AS target_only FROM {function_rates} r JOIN b ON b.word = r.word WHERE r.source = 'src0'""")
query("novelty_distribution", "SELECT signal, round(min(value), 4) AS least, round(@PCT(value;;0.25)@, 4) AS p25, round(median(value), 4) AS p50, round(@PCT(value;;0.75)@, 4) AS p75, round(max(value), 4) AS most, round(@PCT(value;;0.9)@, 4) AS p90 FROM {signals} WHERE value IS NOT NULL GROUP BY signal")
relation("unit_vectors", "SELECT v.vec_id, v.label, v.dim, v.x / n.norm AS x FROM {vector_values} v JOIN (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM {vector_values} GROUP BY vec_id) n ON n.vec_id = v.vec_id")
query("embedding_homogeneity", """
WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS g FROM {unit_vectors} a JOIN {unit_vectors} b ON a.label = b.label AND a.dim = b.dim GROUP BY a.label, a.vec_id, b.vec_id)
SELECT label, count(DISTINCT i) AS n, round(avg(CASE WHEN i < j THEN g END), 5) AS mean_cosine, round(stddev_samp(CASE WHEN i < j THEN g END), 5) AS sd, round(min(CASE WHEN i < j THEN g END), 5) AS least, round(@PCT(CASE WHEN i < j THEN g END;;0.5)@, 5) AS p50, round(power(sum(CASE WHEN i = j THEN g ELSE 0 END), 2) / sum(g * g), 4) AS effective_modes FROM p GROUP BY label""", spark="""
SELECT label, n, round(mean, 5) AS mean_cosine, round(sd, 5) AS sd, round(least, 5) AS least, round(p50, 5) AS p50, round(modes, 4) AS effective_modes FROM {cosine_spread}""")
query("centroid_proximity", """
WITH c AS (SELECT label, dim, avg(x) AS x FROM {unit_vectors} GROUP BY label, dim)
SELECT v.vec_id, round(sum(v.x * c.x) / sqrt(sum(c.x * c.x)), 5) AS cosine FROM {unit_vectors} v JOIN c ON c.label = v.label AND c.dim = v.dim GROUP BY v.vec_id""")
query("embedding_neighbours", """
WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(sum(a.x * b.x), 7) AS g FROM {unit_vectors} a JOIN {unit_vectors} b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id, b.vec_id),
r AS (SELECT label, i, j, g, row_number() OVER (PARTITION BY i ORDER BY g DESC, j) AS k FROM p)
SELECT label, i, j, round(g, 5) AS cosine, k FROM r WHERE k <= 3""", spark="""
SELECT label, i, j, round(g, 5) AS cosine, k FROM (SELECT label, i, j, g, row_number() OVER (PARTITION BY i ORDER BY g DESC, j) AS k FROM {nearest_cosines}) r WHERE k <= 3""")
query("distinct_clusters", """
WITH p AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS sd FROM {vector_values} GROUP BY label, dim)
SELECT label, round(sqrt(sum(m * m)), 5) AS centroid_norm, round(avg(sd), 5) AS spread FROM p GROUP BY label""")
query("family_ranking", """
WITH m AS (SELECT signal, median(value) AS med FROM {signals} WHERE value IS NOT NULL GROUP BY signal),
d AS (SELECT s.signal, 1.4826 * median(abs(s.value - m.med)) AS mad FROM {signals} s JOIN m ON m.signal = s.signal WHERE value IS NOT NULL GROUP BY s.signal),
z AS (SELECT s.doc_id, s.signal, (s.value - med) / nullif(mad, 0) AS z FROM {signals} s JOIN m ON m.signal = s.signal JOIN d ON d.signal = s.signal WHERE value IS NOT NULL),
c AS (SELECT x.lang, z.signal, median(z.z) AS centre FROM z JOIN {documents} x ON x.doc_id = z.doc_id GROUP BY x.lang, z.signal),
e AS (SELECT a.lang AS a, b.lang AS b, sqrt(sum(power(a.centre - b.centre, 2))) AS dist FROM c a JOIN c b ON a.signal = b.signal AND a.lang <> b.lang GROUP BY a.lang, b.lang)
SELECT a, b, round(dist, 4) AS distance, round(1 / (1 + dist), 4) AS similarity FROM e""")
query("controls_triangulation", """
WITH d AS (SELECT a.source, sum(abs(a.rate - b.rate)) AS l1 FROM {function_rates} a JOIN {function_rates} b ON a.word = b.word AND b.source = 'src1' GROUP BY a.source)
SELECT source, round(l1, 6) AS l1, CASE WHEN l1 < 0.02 THEN 'near' WHEN l1 < 0.1 THEN 'between' ELSE 'far' END AS position FROM d""")
query("effect_sizes", """
WITH x AS (SELECT s.doc_id, s.signal, s.value, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS g FROM {signals} s JOIN {documents} d ON d.doc_id = s.doc_id WHERE value IS NOT NULL),
r AS (SELECT x.signal, g, value, v.rk + (v.ties - 1) / 2.0 AS rk FROM x JOIN {value_ranks} v ON v.doc_id = x.doc_id AND v.signal = x.signal),
a AS (SELECT signal, count_if(g = 1) AS n1, count_if(g = 0) AS n0, sum(CASE WHEN g = 1 THEN rk ELSE 0 END) AS r1, avg(CASE WHEN g = 1 THEN value END) AS m1, avg(CASE WHEN g = 0 THEN value END) AS m0, var_samp(CASE WHEN g = 1 THEN value END) AS v1, var_samp(CASE WHEN g = 0 THEN value END) AS v0 FROM r GROUP BY signal)
SELECT signal, round(CAST(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1 AS DOUBLE), 5) AS cliffs_delta, round((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 5) AS cohens_d,
  round((1 - 3.0 / (4 * (n1 + n0) - 9)) * (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 5) AS hedges_g FROM a""")
query("manuscript_dashboard", """
WITH b AS (SELECT signal, avg(value) AS m, stddev_samp(value) AS sd FROM {signals} WHERE value IS NOT NULL GROUP BY signal),
z AS (SELECT d.source, s.signal, (s.value - m) / nullif(sd, 0) AS z FROM {signals} s JOIN b ON b.signal = s.signal JOIN {documents} d ON d.doc_id = s.doc_id WHERE s.value IS NOT NULL)
SELECT source, signal, count_if(round(abs(z), 6) > 1) AS deviating, count_if(z > 0) AS above, count(*) AS n FROM z GROUP BY source, signal""")
query("register_inventory", "SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY GROUPING SETS ((source), (lang), (source, lang))")
query("speaker_profile", """
WITH w AS (SELECT role, word, count(*) AS c FROM {chat_tokens} GROUP BY role, word), n AS (SELECT role, sum(c) AS n, count(*) AS v FROM w GROUP BY role)
SELECT n.role, CAST(n AS BIGINT) AS words, v AS kinds, round(-sum(c / n * log2(c / n)), 5) AS bits FROM w JOIN n ON n.role = w.role GROUP BY n.role, n, v""")
query("speaker_divergence", """
WITH w AS (SELECT t.role, t.word, count(*) AS c FROM {chat_tokens} t JOIN {function_words} f ON f.word = t.word GROUP BY t.role, t.word), n AS (SELECT role, sum(c) AS n FROM w GROUP BY role),
r AS (SELECT n.role, f.word, coalesce(c, 0) * 1.0 / n AS rate FROM n CROSS JOIN {function_words} f LEFT JOIN w ON w.role = n.role AND w.word = f.word)
SELECT a.role AS a, b.role AS b, round(sum(abs(a.rate - b.rate)), 5) AS l1 FROM r a JOIN r b ON a.word = b.word AND a.role < b.role GROUP BY a.role, b.role""")
