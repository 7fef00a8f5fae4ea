"""Secret scans over an incremental blob ledger.

Every version of a document is content-addressed by the SHA-256 of its text: versions() is the table of what stood where.
The ledger is a table in the shared folder with, per blob, the rules (kind@version) under which it was scanned and what
they found. A run takes the blobs of all versions, asks the ledger which rules each has not been scanned under, scans
those pairs alone, appends what it found, and joins the ledger's findings under the present rules back to every path. A
rule that gets a new version is run again by itself over all blobs; the others are not. Where there is no ledger yet,
every pair is to be scanned and texts are read where they lie: only blobs and findings travel. A kept ledger meets the
texts in a join over blobs, for which each distinct text travels once.

Cases: a null text is an empty one; an empty text has no finding; equal texts are one blob with one row in the ledger,
however many rows hold them; a task passes over copies of what it has scanned, and with a kept ledger copies collapse
before the shuffle, but without one a text that stands in several tasks (or MOST_BLOBS other texts apart in one) is
scanned in each and its findings, which are the same, are kept once; a null doc_id is a path like any other; repeated
rows give a row each; spans that start together come in the order of KINDS; a very long text is scanned whole; an empty
table gives no row; a ledger that does not exist yet is empty; extra columns of any name are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import checkpoint_dir

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "url")
BASE = KINDS[:3]
#: The version of each rule; a changed rule gets a new one.
RULES = {"assign": "1", "access": "1", "hex": "1", "pem": "1", "url": "1"}
LEDGER = "blob binary, rules array<string>, hits array<struct<rule: string, start: int, end: int>>"

#: A task remembers so many blobs as scanned, some 130 bytes each, before it begins anew.
MOST_BLOBS = 1 << 18

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
_URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@")


def find(text: str, kinds=KINDS) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then in the order of KINDS."""
    out = []
    low = text.lower()  # a gate only: each assignment holds one of these words in some case
    if "assign" in kinds and any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "access" in kinds and "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if "hex" in kinds:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "pem" in kinds and "-----BEGIN " in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text)]
    if "url" in kinds and "://" in text:
        out += [("url", *m.span()) for m in _URL.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_HITS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[bytes] = set()
    for batch in batches:
        hits, new = [], []
        for i, blob in enumerate(batch.column(0).to_pylist()):
            if blob not in done:
                if len(done) >= MOST_BLOBS:
                    done.clear()
                done.add(blob)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int64())) if len(new) < batch.num_rows else batch
        for text, rules in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            named = {r.split("@")[0]: r for r in rules}
            hits.append([{"rule": named[k], "start": a, "end": b} for k, a, b in find(text.as_py() or "", named)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, _HITS)], ["blob", "rules", "hits"])


def blob_of(text="text"):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def versions(docs: DataFrame, version: str | None = None) -> DataFrame:
    """doc_id, version, blob of every row; version is the column of that name, or 1 where a table has present texts alone."""
    return docs.select("doc_id", (F.lit(1) if version is None else F.col(version)).alias("version"), blob_of().alias("blob"))


def present(rules: dict[str, str] = RULES) -> list[str]:
    return [f"{k}@{v}" for k, v in rules.items()]


def unseen(docs: DataFrame, ledger: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """blob, text, rules: the blobs that lack some of the present rules in the ledger, with these rules."""
    wanted = F.array(*[F.lit(r) for r in present(rules)])
    texts = docs.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return texts.join(seen, "blob", "left").select("blob", "text", missing.alias("rules")).where(F.size("rules") > 0)


def is_kept(docs: DataFrame, path: str) -> bool:
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ledger_at(docs: DataFrame, path: str) -> DataFrame:
    """The ledger kept at path; empty where there is none yet."""
    spark = docs.sparkSession
    return spark.read.schema(LEDGER).parquet(path) if is_kept(docs, path) else spark.createDataFrame([], LEDGER)


def scan_into(docs: DataFrame, path: str, rules: dict[str, str] = RULES) -> DataFrame:
    """Scans what the ledger at path lacks, appends it, and returns the ledger. Rows of an append that was broken off are not committed and are scanned again."""
    if is_kept(docs, path):
        pairs = unseen(docs, ledger_at(docs, path), rules)
    else:  # all pairs, and no exchange of texts
        pairs = docs.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"), F.array(*[F.lit(r) for r in present(rules)]).alias("rules"))
    files = docs.sparkSession.sparkContext.defaultParallelism  # of an append
    pairs.mapInArrow(_scan, LEDGER).repartition("blob").dropDuplicates(["blob"]).coalesce(files).write.mode("append").parquet(path)
    return ledger_at(docs, path)


def findings(docs: DataFrame, path: str | None = None, rules: dict[str, str] = RULES, version: str | None = None) -> DataFrame:
    """Per version of a document: doc_id, version, n_assign, n_access, n_hex, base_sha256, spans. Without a path the ledger is a new one."""
    path = path or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    now = F.array(*[F.lit(r) for r in present(rules)])
    told = scan_into(docs, path, rules).where(F.size("hits") > 0).select("blob", F.explode("hits").alias("x")).where(F.array_contains(now, F.col("x.rule"))).distinct()
    kind = F.split("x.rule", "@")[0]
    span = F.struct(F.col("x.start").alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).alias("nth"), F.concat_ws(":", kind, F.col("x.start"), F.col("x.end")).alias("said"))
    per_blob = told.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("s"))
    said = lambda keep: F.array_join(F.transform(F.filter("s", keep), lambda x: x["said"]), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["nth"] == k)).cast("long")
    of_blob = per_blob.select("blob", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE, 1)], said(lambda x: x["nth"] <= len(BASE)).alias("base"), said(lambda x: F.lit(True)).alias("spans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.lit("")
    joined = versions(docs, version).join(of_blob, "blob", "left")
    return joined.select("doc_id", "version", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))
