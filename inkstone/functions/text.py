"""Text relations: tokens, sentences, paragraphs, lines, shingles and characters, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions.lexicons import CLUSTERS, CONNECTIVES, FUNCTION_WORDS, PRONOUN_SETS, THRESHOLDS
from inkstone.plans.catalogue import builder, relation
from inkstone.sources.tables import table

WORD = "[a-z']+"
WIDE_WORD = r"[\p{L}\p{N}_]+"
MARK = "␞"


def words(text, pattern=WORD):
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def sentences(text):
    """Parts at a blank after .!? before a capital or a quote, or at blank lines."""
    return F.split(F.regexp_replace(text, r"""([.!?])\s+([A-Z"'])""", f"$1{MARK}$2"), f"{MARK}|\n\n+", -1)


def _unnested(array: str, extra: str = "source, lang", source: str = "documents") -> str:
    return f"SELECT doc_id, {extra}, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, {extra}, {array} AS a FROM {source})"


@builder("tokens", _unnested("regexp_extract_all(lower(text), '[a-z'']+')"))
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(words(F.col("text"))).alias("pos", "word"))


@builder("wide_tokens", _unnested(r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"))
def wide_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(words(F.col("text"), WIDE_WORD)).alias("pos", "word"))


@builder("sents", f"""SELECT doc_id, pos AS snum, word AS sent FROM ({_unnested(f"regexp_split_to_array(regexp_replace(text, '([.!?])\\s+([A-Z\"''])', '\\1{MARK}\\2', 'g'), '{MARK}|\n\n+')")}) WHERE regexp_matches(word, '\\S')""")
def sents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("snum", "sent")).where(F.col("sent").rlike(r"\S"))


@builder("lines", f"SELECT doc_id, pos AS lnum, word AS line FROM ({_unnested('string_split(text, chr(10))')})")
def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("lnum", "line"))


def _shingled(k: int, source: str) -> str:
    return f"""SELECT DISTINCT doc_id, list_aggregate(list_slice(a, i, i + {k - 1}), 'string_agg', ' ') AS gram FROM (
      SELECT doc_id, a, unnest(range(1, len(a) - {k - 2})) AS i FROM (SELECT {'doc_id' if source == 'documents' else 'item_id AS doc_id'}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS a FROM {source}) WHERE len(a) >= {k})"""


def _shingles(spark, sf_dir, k, source="documents"):
    key = "doc_id" if source == "documents" else "item_id"
    w = table(spark, sf_dir, source).select(F.col(key).alias("doc_id"), words(F.col("text"), WIDE_WORD).alias("a")).where(F.size("a") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("a") - (k - 1)), lambda i: F.array_join(F.slice("a", i, k), " "))
    return w.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))


@builder("shingles5", _shingled(5, "documents"))
def shingles5(spark, sf_dir):
    return _shingles(spark, sf_dir, 5)


@builder("shingles8", _shingled(8, "documents"))
def shingles8(spark, sf_dir):
    return _shingles(spark, sf_dir, 8)


@builder("shingle_hashes", "")
def shingle_hashes(spark, sf_dir):
    """shingles5 as 64-bit hashes, which travel in place of five words; Spark alone reads it."""
    w = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text"), WIDE_WORD).alias("a")).where(F.size("a") >= 5)
    return w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("a") - 4), lambda i: F.xxhash64(F.slice("a", i, 5))))).alias("h"))


@builder("benchmark8", _shingled(8, "benchmark"))
def benchmark8(spark, sf_dir):
    return _shingles(spark, sf_dir, 8, "benchmark")


@builder("grams8", r"""SELECT doc_id, i - 1 AS pos, list_aggregate(list_slice(a, i, i + 7), 'string_agg', ' ') AS gram FROM (
      SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents) WHERE len(a) >= 8)""")
def grams8(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text"), WIDE_WORD).alias("a")).where(F.size("a") >= 8)
    return w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("a") - 7), lambda i: F.array_join(F.slice("a", i, 8), " "))).alias("pos", "gram"))


@builder("trigrams", "SELECT doc_id, source, lang, substr(t, i, 3) AS gram FROM (SELECT doc_id, source, lang, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, source, lang, lower(text) AS t FROM documents) WHERE length(t) >= 3)")
def trigrams(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lower("text").alias("t")).where(F.length("t") >= 3)
    return t.select("doc_id", "source", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("gram"))


@builder("chat_lines", "SELECT conv_id, turn, role, unnest(range(len(a))) AS lnum, unnest(a) AS line FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS a FROM conversations)")
def chat_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("lnum", "line"))


@builder("chat_tokens", "SELECT conv_id, turn, role, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z'']+') AS a FROM conversations)")
def chat_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(words(F.col("text"))).alias("pos", "word"))


@builder("vector_values", "SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def vector_values(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def _values(rows, names: str) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


def _spark_values(rows, names: str) -> str:
    show = lambda v: '"' + v + '"' if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)} AS v({names})"


def _lexicon(name: str, rows, columns: str) -> None:
    builder(name, _values(rows, columns))(lambda spark, sf_dir: spark.sql(_spark_values(rows, columns)))


_lexicon("function_words", [(w,) for w in FUNCTION_WORDS], "word")
_lexicon("connectives", [(c,) for c in CONNECTIVES], "marker")
_lexicon("word_sets", [(s, w) for s, ws in PRONOUN_SETS.items() for w in ws], "category, word")
_lexicon("clusters", [(s, w) for s, ws in CLUSTERS.items() for w in ws], "cluster, word")
_lexicon("thresholds", THRESHOLDS, "signal, direction, threshold, weight, floor_words, family")

relation("doc_words", "SELECT doc_id, source, lang, word, count(*) AS c FROM {tokens} GROUP BY doc_id, source, lang, word")
relation("doc_totals", "SELECT doc_id, source, lang, sum(c) AS n, count(*) AS v FROM {doc_words} GROUP BY doc_id, source, lang", spark="SELECT doc_id, source, lang, n, v FROM {measures} WHERE n > 0")
relation("sent_words", "SELECT doc_id, snum, @COUNT(lower(sent);;[a-z']+)@ AS w FROM {sents}")
