"""Keyness, collocation and repetition."""

from inkstone.plans.catalogue import query, relation

relation("key_counts", """
WITH a AS (SELECT word, count(*) AS a FROM {tokens} WHERE source = 'src0' GROUP BY word), b AS (SELECT word, count(*) AS b FROM {tokens} WHERE source <> 'src0' GROUP BY word),
u AS (SELECT coalesce(a.word, b.word) AS word, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL OUTER JOIN b ON a.word = b.word),
t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM u)
SELECT word, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(ta AS DOUBLE) AS ta, CAST(tb AS DOUBLE) AS tb FROM u CROSS JOIN t""")
_E = {"e1": "(a + b) * ta / (ta + tb)", "e2": "(a + b) * tb / (ta + tb)", "e3": "(ta + tb - a - b) * ta / (ta + tb)", "e4": "(ta + tb - a - b) * tb / (ta + tb)"}
_O = {"e1": "a", "e2": "b", "e3": "(ta - a)", "e4": "(tb - b)"}
_G2 = " + ".join(f"CASE WHEN {_O[k]} > 0 THEN {_O[k]} * ln({_O[k]} / ({_E[k]})) ELSE 0 END" for k in _E)
_CHI = " + ".join(f"power({_O[k]} - {_E[k]}, 2) / ({_E[k]})" for k in _E)
query("keyness_g2", f"SELECT word, round(2 * ({_G2}), 4) AS g2 FROM {{key_counts}} WHERE a + b >= 5")
query("keyness_chi2", f"SELECT word, round({_CHI}, 4) AS chi2 FROM {{key_counts}} WHERE a + b >= 5")
query("keyness_log_ratio", "SELECT word, round(log2(((a + 0.5) / ta) / ((b + 0.5) / tb)), 6) AS log_ratio FROM {key_counts} WHERE a + b >= 5")
query("keyness_ranking", f"""
WITH s AS (SELECT word, a, b, round(2 * ({_G2}), 4) AS g2, CASE WHEN a / ta >= b / tb THEN 'idiolectic' ELSE 'anti_idiolectic' END AS side FROM {{key_counts}} WHERE a >= 3 OR b >= 3),
r AS (SELECT side, word, g2, row_number() OVER (PARTITION BY side ORDER BY g2 DESC, word) AS k FROM s)
SELECT side, word, g2, k FROM r WHERE k <= 50""")
query("preservation_list", f"""
WITH s AS (SELECT word, length(word) AS n, 2 * ({_G2}) AS g2 FROM {{key_counts}} WHERE a >= 3 AND a / ta > b / tb),
r AS (SELECT word, CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 ELSE 3 END AS grp, round(g2, 4) AS g2 FROM s),
k AS (SELECT word, grp, g2, row_number() OVER (PARTITION BY grp ORDER BY g2 DESC, word) AS k FROM r)
SELECT grp, word, g2, k FROM k WHERE k <= CASE grp WHEN 3 THEN 10 ELSE 20 END""")
# a pair counts from five on; Spark counts pairs and words where the texts lie, without moving tokens
relation("word_pairs", """
WITH t AS (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {tokens}) SELECT word, nxt, count(*) AS c FROM t WHERE nxt IS NOT NULL GROUP BY word, nxt HAVING count(*) >= 5""",
    spark="SELECT word, nxt, c FROM {all_pairs} WHERE c >= 5")
relation("word_totals", "SELECT word, CAST(sum(c) AS BIGINT) AS c FROM {doc_words} GROUP BY word", spark="SELECT word, CAST(sum(c) AS BIGINT) AS c FROM {group_words} GROUP BY word")
relation("pair_counts", """
SELECT b.word, b.nxt, b.c, x.c AS cx, y.c AS cy, n.n FROM {word_pairs} b JOIN {word_totals} x ON x.word = b.word JOIN {word_totals} y ON y.word = b.nxt CROSS JOIN (SELECT CAST(sum(c) AS BIGINT) AS n FROM {word_totals}) n""")
query("collocations_pmi", "SELECT word, nxt, c AS n, round(log2(CAST(c AS DOUBLE) * n / (CAST(cx AS DOUBLE) * cy)), 6) AS pmi FROM {pair_counts}")
_ll = lambda k, n, x: f"({k} * ln(CASE WHEN {x} > 0 THEN {x} ELSE 1 END) + ({n} - {k}) * ln(CASE WHEN {x} < 1 THEN 1 - {x} ELSE 1 END))"
query("collocations_lr", f"""
WITH p AS (SELECT word, nxt, CAST(c AS DOUBLE) AS k1, CAST(cx AS DOUBLE) AS n1, CAST(cy - c AS DOUBLE) AS k2, CAST(n - cx AS DOUBLE) AS n2, CAST(cy AS DOUBLE) / n AS p, CAST(c AS DOUBLE) / cx AS p1, CAST(cy - c AS DOUBLE) / (n - cx) AS p2 FROM {{pair_counts}} WHERE n > cx)
SELECT word, nxt, CAST(k1 AS BIGINT) AS n, round(2 * ({_ll('k1', 'n1', 'p1')} + {_ll('k2', 'n2', 'p2')} - {_ll('k1', 'n1', 'p')} - {_ll('k2', 'n2', 'p')}), 4) AS likelihood_ratio FROM p""")
query("overrepresented_words", """
WITH base AS (SELECT word, sum(c) AS c FROM {doc_words} GROUP BY word), n AS (SELECT sum(c) AS n FROM {doc_words}),
x AS (SELECT w.doc_id, w.word, w.c, 1000.0 * w.c / t.n AS rate, greatest(1000.0 * base.c / n.n, 0.05) AS base FROM {doc_words} w JOIN {doc_totals} t ON t.doc_id = w.doc_id JOIN base ON base.word = w.word CROSS JOIN n LEFT JOIN {function_words} f ON f.word = w.word WHERE f.word IS NULL AND length(w.word) >= 4 AND w.c >= 3)
SELECT doc_id, word, c AS n, round(CAST(rate / base AS DOUBLE), 4) AS ratio FROM x WHERE rate / base >= 1""")
query("densest_clusters", """
WITH c AS (SELECT doc_id, word, count(*) OVER (PARTITION BY doc_id, word ORDER BY pos RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS n FROM {tokens} WHERE length(word) >= 4)
SELECT doc_id, word, max(n) AS densest FROM c GROUP BY doc_id, word HAVING max(n) >= 3""")
query("repetition_rollup", """
SELECT word, count(*) AS docs, CAST(sum(c) AS BIGINT) AS total, max(c) AS most, round(avg(c), 5) AS mean, round(median(c), 5) AS middle FROM {doc_words} WHERE c >= 3 AND length(word) >= 4 GROUP BY word""")
_CHAPTERS = """
WITH c AS (SELECT source, word, sum(c) AS c FROM {doc_words} GROUP BY source, word), n AS (SELECT source, sum(c) AS n FROM c GROUP BY source),
t AS (SELECT word, sum(c) AS c FROM c GROUP BY word), z AS (SELECT sum(n) AS n FROM n)
SELECT c.source, c.word, round((1000.0 * c.c / n.n) / greatest(1000.0 * (t.c - c.c) / (z.n - n.n), 0.05), 4) AS ratio FROM c JOIN n ON n.source = c.source JOIN t ON t.word = c.word CROSS JOIN z WHERE c.c >= 5 AND length(c.word) >= 4"""
query("chapter_distinctiveness", _CHAPTERS, spark=_CHAPTERS.replace("{doc_words}", "{group_words}"))
query("lexical_bundles", """
WITH t AS (SELECT doc_id, word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM {tokens})
SELECT a, b, c, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE c IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 10""")
query("hapax_survival", """
WITH a AS (SELECT word FROM {tokens} WHERE lang = 'en' GROUP BY word HAVING count(*) = 1), b AS (SELECT DISTINCT word FROM {tokens} WHERE lang = 'fr')
SELECT count(*) AS hapaxes, count(b.word) AS surviving, round(count(b.word) * 1.0 / nullif(count(*), 0), 6) AS rate FROM a LEFT JOIN b ON b.word = a.word""")
query("pattern_density", "SELECT source, CAST(sum(@COUNT(text;;!)@) AS BIGINT) AS hits, round(1000.0 * sum(@COUNT(text;;!)@) / nullif(sum(@COUNT(lower(text);;[a-z']+)@), 0), 6) AS per_1000 FROM {documents} GROUP BY source")
query("phrase_survival", """
WITH p AS (SELECT gram FROM {shingles5} GROUP BY gram HAVING count(*) >= 5)
SELECT s.doc_id, count(*) AS phrases FROM {shingles5} s JOIN p ON p.gram = s.gram GROUP BY s.doc_id""", spark="""
WITH p AS (SELECT h FROM {shingle_hashes} GROUP BY h HAVING count(*) >= 5)
SELECT s.doc_id, count(*) AS phrases FROM {shingle_hashes} s LEFT SEMI JOIN p ON p.h = s.h GROUP BY s.doc_id""")
