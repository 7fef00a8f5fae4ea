"""Joins, pairings, set operations and deduplication."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.functions.text import WIDE_WORD, words
from inkstone.plans.catalogue import builder, query, relation
from inkstone.plans.shared import written
from inkstone.sources.tables import table

query("exact_duplicates", "SELECT @SHA(text)@ AS content, count(*) AS copies, min(doc_id) AS keeper FROM {documents} GROUP BY @SHA(text)@ HAVING count(*) > 1")
query("exact_dedup_keep", "SELECT min(doc_id) AS doc_id FROM {documents} GROUP BY @SHA(text)@")
query("short_passage_groups", """
WITH p AS (SELECT trim(@SUB(lower(line);;[^\\p{L}\\p{N}_]+;; )@) AS said FROM {lines})
SELECT said, count(*) AS n FROM p WHERE @COUNT(said;;[^ ]+)@ BETWEEN 1 AND 9 GROUP BY said HAVING count(*) > 1""")
query("shingle_containment", """
WITH q AS (SELECT doc_id, count(*) AS n FROM {benchmark8} GROUP BY doc_id),
s AS (SELECT b.doc_id AS item_id, d.doc_id, count(*) AS shared FROM {benchmark8} b JOIN {shingles8} d ON d.gram = b.gram GROUP BY b.doc_id, d.doc_id)
SELECT s.item_id, s.doc_id, shared, round(shared * 1.0 / n, 6) AS containment, CASE WHEN shared * 100 >= 60 * n THEN 'high' WHEN shared * 100 >= 35 * n THEN 'mid' ELSE 'below' END AS tier FROM s JOIN q ON q.doc_id = s.item_id""")
query("benchmark_contamination", """
WITH hit AS (SELECT DISTINCT g.doc_id, g.pos FROM {grams8} g JOIN (SELECT DISTINCT gram FROM {benchmark8}) b ON b.gram = g.gram),
t AS (SELECT w.doc_id, w.pos, max(h.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near FROM {wide_tokens} w LEFT JOIN hit h ON h.doc_id = w.doc_id AND h.pos = w.pos)
SELECT doc_id, count(*) AS n_tokens, count_if(near IS NOT NULL AND pos - near < 8) AS covered FROM t GROUP BY doc_id""")
# copies stand behind one text each: pairs are of different texts, told by their least doc_id
relation("text_groups", "SELECT md5(text) AS h, min(doc_id) AS rep, count(*) AS copies FROM {documents} WHERE text IS NOT NULL GROUP BY md5(text)")
relation("rep_shingles", "SELECT s.doc_id, s.gram FROM {shingles5} s JOIN {text_groups} g ON g.rep = s.doc_id")


BUCKETS = 1 << 20


def _bucket_sizes(sets):
    """How many grams of all sets fall to each bucket: an array of one size, whatever the input."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "c"])

    told = sets.select("grams").mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    sizes = np.zeros(BUCKETS, np.int64)
    sizes[told.column("bucket").to_numpy()] = told.column("c").to_numpy()
    return np.minimum(sizes, 2**32 - 1).astype(np.uint32)


def prefix_of(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first grams of a set by the size of their bucket: two sets of likeness 0.8 or more share one of these, in whatever order all sets have in common."""
    n = len(grams)
    order = np.lexsort((grams, sizes[grams & (BUCKETS - 1)]))
    return grams[order[: n - -(-4 * n // 5) + 1]]


@builder("gram_sets", "")
def gram_sets(spark, sf_dir):
    """doc_id, grams (distinct 64-bit hashes of five-word runs), n, prefix: of each document; a table, as the join reads it several times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words_of = docs.select("doc_id", words(F.col("text"), WIDE_WORD).alias("a")).where(F.size("a") >= 5)
    grams = F.transform(F.sequence(F.lit(1), F.size("a") - 4), lambda i: F.xxhash64(F.slice("a", i, 5)))
    hashed = words_of.select("doc_id", F.array_distinct(grams).alias("grams")).withColumn("n", F.size("grams").cast("long"))
    sets = written(hashed)
    sizes = _bucket_sizes(sets)

    @F.pandas_udf("array<bigint>")
    def prefix(of: pd.Series) -> pd.Series:
        return of.map(lambda grams: prefix_of(np.asarray(grams, np.int64), sizes))

    return sets.withColumn("prefix", prefix("grams"))


# prefix filter: two sets that reach the threshold share a shingle of their prefixes; in the SQL these are the rarest, those of
# one text alone first; on Spark those of the emptiest buckets, so that common ones come last and no shingle is counted by itself
relation("near_pairs", """
WITH f AS (SELECT gram, count(*) AS df FROM {rep_shingles} GROUP BY gram),
s AS (SELECT x.doc_id, x.gram, count(*) OVER (PARTITION BY x.doc_id) AS n, row_number() OVER (PARTITION BY x.doc_id ORDER BY df, x.gram) AS k FROM {rep_shingles} x JOIN f ON f.gram = x.gram),
p AS (SELECT doc_id, gram, n FROM s WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
j AS (SELECT c.a, c.b, na, nb, count(*) AS shared FROM c JOIN {rep_shingles} x ON x.doc_id = c.a JOIN {rep_shingles} y ON y.doc_id = c.b AND y.gram = x.gram GROUP BY c.a, c.b, na, nb)
SELECT a, b, shared, na + nb - shared AS in_all FROM j WHERE shared * 5 >= 4 * (na + nb - shared)""", spark="""
WITH p AS (SELECT doc_id, n, explode(prefix) AS gram FROM {gram_sets} s LEFT SEMI JOIN {text_groups} g ON g.rep = s.doc_id),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
j AS (SELECT c.a, c.b, x.n AS na, y.n AS nb, CAST(size(array_intersect(x.grams, y.grams)) AS BIGINT) AS shared FROM c JOIN {gram_sets} x ON x.doc_id = c.a JOIN {gram_sets} y ON y.doc_id = c.b)
SELECT a, b, shared, na + nb - shared AS in_all FROM j WHERE shared * 5 >= 4 * (na + nb - shared)""")
query("near_dup_pairs", "SELECT a, b, shared, in_all, round(shared * 1.0 / in_all, 6) AS jaccard FROM {near_pairs}")
query("text_membership", "SELECT d.doc_id, g.rep, g.copies FROM {documents} d JOIN {text_groups} g ON g.h = md5(d.text)")
query("near_dup_degrees", """
WITH e AS (SELECT a AS rep, b AS other FROM {near_pairs} UNION ALL SELECT b, a FROM {near_pairs}),
l AS (SELECT e.rep, sum(g.copies) AS near FROM e JOIN {text_groups} g ON g.rep = e.other GROUP BY e.rep)
SELECT d.doc_id AS doc, CAST(g.copies - 1 + coalesce(l.near, 0) AS BIGINT) AS partners FROM {documents} d JOIN {text_groups} g ON g.h = md5(d.text) LEFT JOIN l ON l.rep = g.rep WHERE g.copies > 1 OR l.near > 0""")
# 64-bit hashes travel in place of eight words; equal grams are counted with map-side combination, not in a window
relation("repeated8", """
WITH g AS (SELECT md5(gram) AS h FROM {grams8} GROUP BY md5(gram) HAVING count(*) >= 2) SELECT x.doc_id, x.pos FROM {grams8} x JOIN g ON g.h = md5(x.gram)""", spark="""
WITH x AS (SELECT doc_id, pos, xxhash64(gram) AS h FROM {grams8}), g AS (SELECT h FROM x GROUP BY h HAVING count(*) >= 2) SELECT x.doc_id, x.pos FROM x LEFT SEMI JOIN g ON g.h = x.h""")
query("repeated_spans", """
WITH h AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {repeated8}),
s AS (SELECT doc_id, island, min(pos) AS start_token, max(pos) + 8 AS end_token FROM h GROUP BY doc_id, island)
SELECT doc_id, start_token, end_token FROM s WHERE end_token - start_token >= 20""")
query("span_masks", """
WITH h AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {repeated8}),
s AS (SELECT doc_id, island, max(pos) + 8 - min(pos) AS len FROM h GROUP BY doc_id, island)
SELECT doc_id, count(*) AS spans, CAST(sum(len) AS BIGINT) AS tokens, max(len) AS longest FROM s WHERE len >= 20 GROUP BY doc_id""")
query("leave_one_out_vocabulary", """
WITH t AS (SELECT word, count(*) AS docs FROM {doc_words} GROUP BY word)
SELECT w.doc_id, count(*) AS kinds, count_if(t.docs = 1) AS own_only FROM {doc_words} w JOIN t ON t.word = w.word GROUP BY w.doc_id""")
query("self_exclusion", "SELECT b.item_id FROM {benchmark} b WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.text = b.text)")
query("corrections_overlay", "SELECT d.doc_id, coalesce(CAST(l.quality AS STRING), d.lang) AS register FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id")
query("unmatched_corrections", "SELECT l.doc_id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id)")
query("vocabulary_union", "SELECT word FROM {tokens} WHERE lang = 'en' UNION SELECT word FROM {tokens} WHERE lang = 'de'")
query("vocabulary_intersection", "SELECT word FROM {tokens} WHERE lang = 'en' INTERSECT SELECT word FROM {tokens} WHERE lang = 'fr'")
query("vocabulary_difference", "SELECT word FROM {tokens} WHERE lang = 'es' EXCEPT SELECT word FROM {tokens} WHERE lang = 'fr'")
query("multiset_diff", """
WITH a AS (SELECT word, count(*) AS n FROM {tokens} WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*) AS n FROM {tokens} WHERE lang = 'fr' GROUP BY word)
SELECT coalesce(a.word, b.word) AS word, coalesce(a.n, 0) AS before_n, coalesce(b.n, 0) AS after_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS diff FROM a FULL OUTER JOIN b ON a.word = b.word""")
query("remediation_decisions", """
WITH g AS (SELECT md5(line) AS h, count(*) AS n, min(struct(doc_id, lnum)) AS first FROM {lines} WHERE length(line) >= 20 GROUP BY md5(line) HAVING count(*) > 1)
SELECT x.doc_id, x.lnum, CASE WHEN x.doc_id = g.first.doc_id AND x.lnum = g.first.lnum THEN 'representative' ELSE 'masked' END AS decision FROM {lines} x JOIN g ON g.h = md5(x.line) WHERE length(x.line) >= 20""".replace("min(struct(doc_id, lnum))", "min(@PAIR(doc_id;;lnum)@)"))
query("cluster_balance", """
WITH c AS (SELECT line, count(*) AS n FROM {lines} WHERE length(line) >= 20 GROUP BY line HAVING count(*) > 1)
SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, CAST(sum(n - 1) AS BIGINT) AS masked FROM c""")
# each focal document with the others of its topic; rows of one doc_id are not its others
query("topic_pairing", """
WITH g AS (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang), own AS (SELECT doc_id, source, lang, count(*) AS n FROM {documents} GROUP BY doc_id, source, lang)
SELECT own.doc_id AS focal, CAST(own.n * (g.n - own.n) AS BIGINT) AS others FROM own JOIN g ON g.source IS NOT DISTINCT FROM own.source AND g.lang IS NOT DISTINCT FROM own.lang WHERE g.n > own.n""")
query("cosine_pairs", """
WITH n AS (SELECT vec_id, label, sqrt(sum(x * x)) AS norm FROM {vector_values} GROUP BY vec_id, label),
v AS (SELECT v.vec_id, v.label, v.dim, v.x / n.norm AS x FROM {vector_values} v JOIN n ON n.vec_id = v.vec_id WHERE v.vec_id < 200),
p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.dim = b.dim AND a.vec_id < b.vec_id GROUP BY a.label, a.vec_id, b.vec_id)
SELECT label, i, j, round(cosine, 5) AS cosine FROM p""".replace(" WHERE v.vec_id < 200", ""), spark="SELECT label, i, j, round(cosine, 5) AS cosine FROM {every_cosine}")
query("same_author_pairs", """
WITH r AS (SELECT source, lang, avg(n_chars) AS mean FROM {documents} GROUP BY source, lang)
SELECT a.source AS a_source, a.lang AS a_lang, b.source AS b_source, b.lang AS b_lang, CASE WHEN a.source = b.source THEN 1 ELSE 0 END AS same, round(abs(a.mean - b.mean), 4) AS distance FROM r a JOIN r b ON (a.source < b.source OR (a.source = b.source AND a.lang < b.lang))""")
