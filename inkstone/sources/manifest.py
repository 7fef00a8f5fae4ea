"""Manifests: strict scan of JSON lines, and validation of entries by a table of rules.

strict_rows() gives every line that is neither blank nor a comment its number in its file, its object, and what is wrong
with it: no object, a repeated key, a number that is none (NaN, Infinity), a byte-order mark, or bytes that are no UTF-8. Files are
split as Spark splits them; numbers come from counts per split, a few numbers each.

issues() evaluates RULES over typed entries: a row per finding, errors and warnings. Each rule is a condition over one entry;
repeated ids and paths are found by aggregates. Nulls are missing values; an empty table gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import manifest_rules as R

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_has = lambda *tags: "(" + " OR ".join(f"coalesce(array_contains(used, '{t}'), false)" for t in tags) + ")"
_void = lambda c: f"({c} IS NULL OR trim({c}) = '')"

#: severity, field, name, condition (the field `use` is named used in SQL).
RULES: tuple[tuple[str, str, str, str], ...] = (
    *(("error", f, "missing", f"{'used' if f == 'use' else f} IS NULL") for f in R.REQUIRED),
    *(("warning", f, "unknown_value", f"{f} IS NOT NULL AND {f} NOT IN {_in([*vs, *(R.RETIRED_REGISTERS if f == 'register' else [])])}") for f, vs in R.ALLOWED.items()),
    ("error", "register", "retired", f"register IN {_in(R.RETIRED_REGISTERS)}"),
    ("error", "source_family", "unknown_value", f"source_family IS NOT NULL AND source_family NOT IN {_in(R.SOURCE_FAMILY)}"),
    ("error", "use", "validation_in_baseline_split", f"{_has('validation')} AND split = 'baseline'"),
    ("warning", "use", "baseline_outside_its_split", f"{_has('baseline')} AND split IN ('train', 'test', 'holdout')"),
    ("error", "use", "profile_only_register", f"register IN {_in(R.PROFILE_ONLY_REGISTERS)} AND {_has('baseline')}"),
    ("warning", "privacy", "voice_not_private", f"{_has('voice_profile', 'idiolect')} AND coalesce(privacy, '') <> 'private'"),
    ("warning", "ai_status", "coauthored_human", "ai_status = 'pre_ai_human' AND editing_status = 'coauthored'"),
    ("warning", "ai_status", "mixed_without_states", "ai_status = 'mixed' AND coalesce(composite_states, 0) = 0"),
    ("warning", "language_status", "learner_baseline", f"language_status IN ('non_native_advanced', 'non_native_intermediate', 'learner') AND {_has('baseline')}"),
    ("warning", "language_status", "learner_voice", f"language_status IN ('non_native_advanced', 'non_native_intermediate', 'learner') AND {_has('voice_profile', 'idiolect')}"),
    ("error", "word_count", "negative", "word_count < 0"),
    *(("error", f, "impostor_without", f"corpus_role = 'impostor' AND {_void(f)}") for f in ("register_match", "topic_match", "consent_status", "era", "acquired_via")),
    ("error", "impostor_for", "impostor_without", "corpus_role = 'impostor' AND coalesce(n_impostor_for, 0) = 0"),
    ("warning", "consent_status", "undocumented_impostor", "corpus_role = 'impostor' AND consent_status = 'undocumented'"),
    ("warning", "era", "late_impostor", "corpus_role = 'impostor' AND era = 'post_ai_widespread'"),
    ("warning", "era", "baseline_without_era", f"coalesce(corpus_role, 'identity_baseline') = 'identity_baseline' AND era IS NULL AND {_has('baseline', 'voice_profile', 'voice_validation', 'idiolect', 'voice_impostor')}"),
    ("warning", "ai_status", "late_human", "ai_status = 'pre_ai_human' AND era = 'post_ai_widespread'"),
)
#: Columns that the rules read; issues() adds those that entries lack, as nulls.
COLUMNS = {c: "string" for c in ("id", "path", *R.ALLOWED, "source_family", "acquired_via")} | {"used": "array<string>", "composite_states": "bigint", "n_impostor_for": "bigint", "word_count": "double"}


def issues(entries: DataFrame) -> DataFrame:
    """severity, id, field, issue: a row per finding, for entries with columns of COLUMNS (any missing)."""
    typed = entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    finding = lambda severity, field, name: F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(name).alias("issue"))
    allowed = F.array(*[F.lit(u) for u in R.USE])
    found = [F.when(F.expr(condition), finding(severity, field, name)) for severity, field, name, condition in RULES]
    found.append(F.when(F.size(F.array_except(F.coalesce("used", F.array().cast("array<string>")), allowed)) > 0, finding("warning", "use", "unknown_value")))
    single = typed.select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.severity", "id", "x.field", "x.issue")
    ids = typed.where("id is not null").groupBy("id").count().where("count > 1").select(F.lit("error").alias("severity"), "id", F.lit("id").alias("field"), F.lit("repeated").alias("issue"))
    shared = typed.where("path is not null and id is not null").groupBy("path").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id <> other").select(F.lit("warning").alias("severity"), "id", F.lit("path").alias("field"), F.lit("shared").alias("issue"))
    return single.unionByName(ids).unionByName(shared)


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(word):
    raise ValueError(f"{word} is no number")


def parsed(raw: bytes) -> tuple[str | None, str | None]:
    """The object of a line as canonical JSON, and what is wrong with the line."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return None, "byte-order mark"
    try:
        line = raw.decode()
    except UnicodeDecodeError:
        return None, "no UTF-8"
    try:
        value = json.loads(line, object_pairs_hook=_no_repeats, parse_constant=_refuse)
    except (ValueError, RecursionError) as e:
        return None, str(e).split(":")[0]
    return (json.dumps(value, sort_keys=True, ensure_ascii=False), None) if isinstance(value, dict) else (None, "no object")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parsed(v) for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["file", "line", "entry", "problem"])


def strict_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), entry (JSON), problem, for each line that is neither blank nor a comment."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = counts.select("file", "block", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    numbered = raw.join(F.broadcast(before), ["file", "block"]).select("file", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("line"), "value")
    return numbered.where("trim(value) <> '' AND NOT startswith(trim(value), '#')").withColumn("value", F.col("value").cast("binary")).mapInArrow(_parse, "file string, line long, entry string, problem string")


def parse_filters(text: str) -> list[tuple[str, str]]:
    """key=value pairs between commas; a key without a value, or none, is refused."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, mark, value = (x.strip() for x in part.partition("="))
        if not (key and mark and value):
            raise ValueError(f"{part!r} is not key=value")
        out.append((key, value))
    return out


def filtered(entries: DataFrame, text: str) -> DataFrame:
    """Entries for which every pair holds; an array holds a value that is one of its members."""
    kinds = dict(entries.dtypes)
    for key, value in parse_filters(text):
        if key not in kinds:
            raise ValueError(f"no field {key!r}")
        entries = entries.where(F.array_contains(key, value) if kinds[key].startswith("array") else F.col(key).cast("string") == value)
    return entries


def conflict_copies(files: DataFrame, column: str = "path") -> DataFrame:
    """Files whose names are those of copies left behind by synchronisation."""
    return files.where(F.element_at(F.split(column, "/"), -1).rlike(R.CONFLICT_NAME))
