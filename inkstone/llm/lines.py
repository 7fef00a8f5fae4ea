"""Line deduplication: a suffix array over line-ID sequences by distributed prefix doubling.

Each line has an ID (128 bits of its hash); a document is a sequence of IDs, and each place in it begins a suffix. Round
k ranks the prefixes of 2**k lines: distinct names (a line's ID; from then on the pair of ranks of a place and of the one
2**(k-1) lines further on) are counted, those of one place are dropped, as nothing longer from there repeats, and the
others are sorted by ranges, so that their numbers are their ranks in the order of suffixes. Suffixes of one rank form a
longest-common-prefix interval at least 2**k deep, and any prefix between two powers is told by the ranks of the two
overlapping prefixes of 2**k lines that make it up. Rounds go as deep as a run has to reach.

A run of lines counts from LEAST characters on, over however many lines: one long line or several short ones. In each
stretch of repeated lines every place begins a shortest such run, and ends one; the intervals of these runs say whether
the run also begins at a smaller (doc_id, text hash, place), its source. Such runs are later copies. Their union is that
of all maximal repeated runs with an earlier copy, and its lines are deleted.

Only DataFrame functions are used. Names are counted with map-side combination and then written, so that the joins with
them stand alone and adaptive execution splits hot ones. Cases: a null text stays null and has no line; an empty text is
one empty line; a document all of whose lines go keeps an empty text; a null doc_id has no place in the order: its
document loses nothing and takes nothing; repeated rows (doc_id and text) count as one document and share its result,
texts of one doc_id are ordered by their hashes; a text of very many lines is split whole in one row, its places are rows
of their own; an empty table gives no row; extra columns of any name stay in keep() and are ignored in report().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import aside, cut_table, discard, free, partitions

#: Characters from which on a run counts, over all its lines.
LEAST = 60
_DOC = ("did", "th")
_PLACE = (*_DOC, "pos")


def _ranked(names: DataFrame, *keys: str) -> DataFrame:
    """Distinct names of more than one place (keys, n) with rank, ascending by keys over all partitions."""
    spread = names.where("n > 1").repartitionByRange(partitions(names.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut_table(spread.select(*keys, F.monotonically_increasing_id().alias("rank")))


def _doubled(level: DataFrame, by: int) -> DataFrame:
    """Places with their rank and that of the place `by` lines further on, where there is one."""
    there = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(by, by)
    return level.withColumn("next", F.first("rank").over(there)).where("next is not null")


def _shortest(level: DataFrame, least: int) -> DataFrame:
    """did, th, pos, m: the shortest runs of `least` characters that begin or end at each place, inside stretches of repeated lines."""
    stretch = Window.partitionBy(*_DOC).orderBy("pos")
    whole = Window.partitionBy(*_DOC, "stretch").orderBy("pos")
    upto = level.withColumn("stretch", F.col("pos") - F.row_number().over(stretch)).withColumn("upto", F.sum("chars").over(whole))
    place = [*_DOC, "stretch"]
    line = lambda key, first: F.struct(key.alias("key"), F.lit(first).alias("kind"), F.col("pos").alias("p"))
    before = F.col("upto") - F.col("chars")
    # from its end a run looks back for the last begin, from its begin ahead for the first end that makes it long enough
    back = upto.select(*place, F.explode(F.array(line(before, 0), line(F.col("upto") - least, 1))).alias("x")).select(*place, "x.*")
    last = F.max(F.when(F.col("kind") == 0, F.col("p"))).over(Window.partitionBy(*place).orderBy("key", "kind", "p").rowsBetween(Window.unboundedPreceding, 0))
    ending = back.withColumn("pos", last).where("kind = 1 and pos is not null").select(*_DOC, "pos", (F.col("p") - F.col("pos") + 1).alias("m"))
    ahead = upto.select(*place, F.explode(F.array(line(F.col("upto"), 0), line(before + least, 1))).alias("x")).select(*place, "x.*")
    first = F.min(F.when(F.col("kind") == 0, F.col("p"))).over(Window.partitionBy(*place).orderBy(F.col("key").desc(), "kind", "p").rowsBetween(Window.unboundedPreceding, 0))
    begun = ahead.withColumn("end", first).where("kind = 1 and end is not null").select(*_DOC, F.col("p").alias("pos"), (F.col("end") - F.col("p") + 1).alias("m"))
    return begun.unionByName(ending).where("m > 0").distinct()


def later_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Shortest runs that have an earlier copy: did, th, pos, m (lines), source (the first copy's document)."""
    line = lambda n: F.xxhash64(F.lit(n), "line")
    base = docs.where("doc_id is not null").select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = base.select(*_DOC, F.col("pos").cast("long").alias("pos"), line(1).alias("h1"), line(2).alias("h2"), F.length("line").cast("long").alias("chars"))
    names = _ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")), "h1", "h2")
    level = cut_table(lines.join(names, ["h1", "h2"]).select(*_PLACE, "rank", "chars").distinct())
    discard(names)
    runs = cut_table(_shortest(level, max(least, 1)))
    deepest = runs.agg(F.max("m")).first()[0] or 0
    levels = [level]
    while deepest >= 1 << len(levels):
        pairs = _doubled(levels[-1].select(*_PLACE, "rank"), 1 << (len(levels) - 1))
        names = _ranked(pairs.groupBy(F.col("rank").alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("n")), "a", "b")
        levels.append(cut_table(pairs.withColumnsRenamed({"rank": "a", "next": "b"}).join(names, ["a", "b"]).select(*_PLACE, "rank")))
        discard(names)
    ranks = reduce(DataFrame.unionByName, [t.select(*_PLACE, F.lit(k).alias("k"), "rank") for k, t in enumerate(levels)])
    power = F.length(F.bin("m")) - 1  # the greatest of two that m lines hold
    asked = runs.withColumn("k", power).withColumn("last", F.col("pos") + F.col("m") - F.expr("shiftleft(1L, length(bin(m)) - 1)"))
    tail = ranks.select(*_DOC, F.col("pos").alias("last"), "k", F.col("rank").alias("next"))
    told = cut_table(asked.join(ranks, [*_PLACE, "k"]).join(tail, [*_DOC, "last", "k"]).select(*_PLACE, "m", "rank", "next"))
    discard(runs, *levels)
    interval, place = ["m", "rank", "next"], F.struct(*_PLACE)
    firsts = cut_table(told.groupBy(*interval).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    return told.join(firsts, interval).where(place > F.col("first")).select(*_PLACE, "m", F.col("first.did").alias("source"))


def deleted_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """did, th, a, z, source: maximal runs of lines that go, from line a to line z, and the document of its first piece's first copy."""
    marks = later_copies(docs, least).select(*_DOC, F.col("pos").alias("a"), (F.col("pos") + F.col("m") - 1).alias("z"), "source")
    order = Window.partitionBy(*_DOC).orderBy("a", "z")
    reach = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = marks.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*_DOC, "run").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min_by("source", F.struct("a", "z")).alias("source")).drop("run")


def keep(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with later copies deleted from text, and further columns (names with more underscores where docs has them):
    _lines, _removed, _runs (maximal deleted runs), _longest (lines of the longest of them), _source (its source, as a string)."""
    run = F.struct(F.col("a"), F.col("z"), F.col("source"))
    per_doc = deleted_runs(docs, least).groupBy(*_DOC).agg(F.array_sort(F.collect_list(run)).alias("gone"))
    split = aside(docs).withColumns({"split": F.split("text", "\n", -1), "own": F.xxhash64("text")}).drop("text")
    joined = split.join(per_doc, (F.col("doc_id") == F.col("did")) & (F.col("own") == F.col("th")), "left")
    zero, size = F.lit(0).cast("long"), F.size("split").cast("long")
    begins = F.concat(F.array(zero), F.transform("gone", lambda r: r["z"] + 1))
    ends = F.concat(F.transform("gone", lambda r: r["a"]), F.array(size))
    left = F.flatten(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda g: F.slice("split", (g["b"] + 1).cast("int"), (g["e"] - g["b"]).cast("int"))))
    length = lambda r: r["z"] - r["a"] + 1
    longest = F.array_max(F.transform("gone", lambda r: F.struct(length(r).alias("n"), (-r["a"]).alias("a"), r["source"].cast("string").alias("source"))))
    none = F.col("gone").isNull()
    counts = {
        "_lines": F.when(F.col("split").isNull(), zero).otherwise(size),
        "_removed": F.when(none, zero).otherwise(F.aggregate("gone", zero, lambda n, r: n + length(r))),
        "_runs": F.when(none, zero).otherwise(F.size("gone").cast("long")),
        "_longest": F.coalesce(longest["n"], zero),
        "_source": longest["source"],
    }
    told = joined.select("row", F.array_join(F.when(none, F.col("split")).otherwise(left), "\n").alias("text"), F.struct(*[v.alias(c) for c, v in counts.items()]).alias("told"))
    old = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return told.select(*old, *[F.col(f"told.{c}").alias(free(docs, c)) for c in counts])


def removed_name(docs: DataFrame) -> str:
    """The name in keep(docs) of the number of lines removed."""
    return free(docs, "_removed")


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, text (what is left), n_lines, n_removed, n_runs, longest_run (lines)."""
    kept = keep(docs.select("doc_id", "text"), least)
    return kept.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_runs"), F.col("_longest").alias("longest_run"))


#: The same by lists of lines: every shortest run of 60 characters is compared as a list; doc_id tells a document.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM d),
c AS (SELECT doc_id, pos, line, length(line) AS n, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
p AS (SELECT s.doc_id, s.pos AS a, e.pos AS z FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.n >= 60),
w AS (SELECT doc_id, a, min(z) AS z FROM p GROUP BY doc_id, a UNION SELECT doc_id, max(a), z FROM p GROUP BY doc_id, z),
k AS (SELECT w.doc_id, w.a, w.z, row_number() OVER (PARTITION BY list_slice(d.a, w.a + 1, w.z + 1) ORDER BY w.doc_id, w.a) > 1 AS later FROM w JOIN d ON d.doc_id = w.doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS pos FROM k WHERE later),
g AS (SELECT c.doc_id, c.pos, c.line, x.pos IS NOT NULL AS gone FROM c LEFT JOIN x ON x.doc_id = c.doc_id AND x.pos = c.pos),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM g),
i AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
m AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM i WHERE gone GROUP BY doc_id, run) GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count_if(gone) AS n_removed, count_if(begins) AS n_runs FROM r GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_runs, 0)::BIGINT AS n_runs, coalesce(m.longest, 0)::BIGINT AS longest_run
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
