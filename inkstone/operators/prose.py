"""Prose hygiene: what is not prose is taken out of a text by ordered rules, and told rule by rule.

A rule finds spans; a span gives way to one line end, or two if it held any, so that what stood around it stays apart.
Pattern rules find matches; line rules find blocks of lines: three or more indented lines, at-rules and rule blocks of
style sheets, objects of quoted keys, tables of three or more lines with a rule or an even number of columns. A rule sees
what the rules before it have left. Words are runs without white space.

One pass of Arrow batches, a text whole in one task, nothing shuffled. Null texts stay null and have no words; an empty
table gives no row. There is no SQL for rules over blocks, so tests hold rules against cases worked out by hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import prose_rules as R
from inkstone.sources.tables import table

Span = tuple[int, int]


def _blocks(text: str, begins: Callable[[list[str], int], int]) -> list[Span]:
    """Spans of line blocks: begins(lines, i) is the line after the block that begins at line i, or i if none does."""
    lines = text.splitlines(keepends=True)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    out, i = [], 0
    while i < len(lines):
        j = begins(lines, i)
        if j > i:
            out.append((at[i], at[j]))
        i = max(j, i + 1)
    return out


def _while(pattern: str, lines: list[str], i: int) -> int:
    matches = re.compile(pattern).match
    while i < len(lines) and matches(lines[i]):
        i += 1
    return i


def _balanced(lines: list[str], i: int, most: int) -> int:
    """The line after that in which the braces opened from line i on are closed; i if they are not within `most` lines."""
    depth, opened = 0, False
    for j in range(i, min(len(lines), i + most)):
        depth += lines[j].count("{") - lines[j].count("}")
        opened |= "{" in lines[j]
        if opened and depth <= 0 and "}" in lines[j]:
            return j + 1
    return i


def indented_code(lines: list[str], i: int) -> int:
    j = _while(R.INDENTED, lines, i)
    return j if j - i >= 3 else i


def css_at_rule(lines: list[str], i: int) -> int:
    if not re.match(R.CSS_AT, lines[i]):
        return i
    return max(_balanced(lines, i, R.BLOCK_LINES["css_at_rule"]), i + 1) if "{" in lines[i] else i + 1


def _selects(selector: str) -> bool:
    """Whether the last word before a brace selects: a class, an id, a pseudo-class, or the name of an element."""
    last = selector.split()[-1] if selector.strip() else ""
    element = re.match(r"[A-Za-z][\w-]*", last)
    if re.match(r"[.#]-?[A-Za-z_][\w-]*", last) or last[:1] in ("*", "[", ":"):
        return last != ""
    return bool(element) and element[0].lower() in R.HTML_TAGS and (len(last) == element.end() or last[element.end()] in ".#:[")


def _declares(inner: str) -> bool:
    """Whether all parts are declarations, none with a format directive, and one of a known property."""
    parts = [p.strip() for p in inner.split(";") if p.strip()]
    pairs = [p.split(":", 1) for p in parts if re.match(R.CSS_DECLARATION, p)]
    known = lambda name: name in R.CSS_PROPERTIES or name.startswith("--") or bool(re.fullmatch(r"-[a-z]+-[a-z][a-z-]*", name))
    return bool(parts) and len(pairs) == len(parts) and not any(re.search("%[A-Za-z]", v) for _, v in pairs) and any(known(n.strip().lower()) for n, _ in pairs)


def css_rule_block(lines: list[str], i: int) -> int:
    j = _balanced(lines, i, R.BLOCK_LINES["css_rule_block"]) if re.match(R.CSS_OPEN, lines[i]) else i
    block = "".join(lines[i:j])
    head = block.split("{", 1)[0].splitlines()
    return j if head and _selects(head[-1]) and any(_declares(x) for x in re.findall(r"\{([^{}]*)\}", block)) else i


def json_block(lines: list[str], i: int) -> int:
    j = _balanced(lines, i, R.BLOCK_LINES["json_block"]) if lines[i].strip() == "{" else i
    keys = sum(bool(re.match(R.JSON_KEY, x)) for x in lines[i:j])
    return j if j - i >= 3 and keys >= 2 and keys >= 0.3 * (j - i) else i


def ascii_table(lines: list[str], i: int) -> int:
    j = _while(R.TABLE_LINE, lines, i)
    rows = [x.count("|") for x in lines[i:j] if re.match(R.TABLE_ROW, x)]
    even = len(rows) >= 2 and len(set(rows)) == 1
    return j if j - i >= 3 and (even or any(re.match(R.TABLE_RULE, x) for x in lines[i:j])) else i


_LINE_RULES = {f.__name__: f for f in (indented_code, css_at_rule, css_rule_block, json_block, ascii_table)}


@cache
def rules(aggressive: bool = False, profile: str = "none") -> tuple[tuple[str, Callable[[str], list[Span]]], ...]:
    """The rules in force, in order: name, and what finds its spans."""
    some = [*R.DEFAULT, *(R.AGGRESSIVE if aggressive else ()), *(r for r in R.MASKING if r[0] in R.PROFILES[profile])]

    def finder(name: str, pattern: str | None) -> Callable[[str], list[Span]]:
        if pattern is None:
            return lambda text: _blocks(text, _LINE_RULES[name])
        found = re.compile(pattern)
        return lambda text: [m.span() for m in found.finditer(text)]

    return tuple((name, finder(name, pattern)) for name, pattern in some)


_LINK = re.compile(dict(R.AGGRESSIVE)["markdown_link_url"])


def clean(text: str, aggressive: bool = False, profile: str = "none") -> tuple[str, dict[str, int]]:
    """What is left of a text, and the words that each rule took."""
    taken: dict[str, int] = {}
    for name, find in rules(aggressive, profile):
        out, done = [], 0
        for a, b in find(text):
            gone, fill = text[a:b], "\n" * max(1, min(text.count("\n", a, b) + 1, 2))
            if name == "markdown_link_url":
                fill = _LINK.match(gone)[1]
                gone = gone.replace(fill, "", 1)
            taken[name] = taken.get(name, 0) + len(gone.split())
            out += [text[done:a], fill]
            done = b
        if done or out:
            text = "".join([*out, text[done:]])
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), taken


def _cleaner(aggressive: bool, profile: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, before, after, taken = [], [], [], []
            for t in batch.column(1).to_pylist():
                own, by = (None, {}) if t is None else clean(t, aggressive, profile)
                left.append(own)
                before.append(len((t or "").split()))
                after.append(len((own or "").split()))
                taken.append(list(by.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(taken, pa.map_(pa.string(), pa.int64()))], ["doc_id", "text", "before", "after", "taken"])

    return run


def cleaned(docs: DataFrame, aggressive: bool = False, profile: str = "none") -> DataFrame:
    """doc_id, text (what is left), before and after (words), taken (words by rule)."""
    base = docs.select("doc_id", "text")
    return base.mapInArrow(_cleaner(aggressive, profile), f"doc_id {dict(base.dtypes)['doc_id']}, text string, before long, after long, taken map<string, bigint>")


def judged(rows: DataFrame) -> DataFrame:
    """With stripped, ratio, status and the dominant rule (most words; of equal ones the first in order)."""
    order = F.array(*[F.lit(n) for n, _ in [*R.DEFAULT, *R.AGGRESSIVE, *R.MASKING]])
    stripped = F.greatest(F.col("before") - F.col("after"), F.lit(0))
    ratio = F.when(F.col("before") > 0, stripped / F.col("before")).otherwise(0.0)
    first = F.array_max(F.transform(F.map_entries("taken"), lambda e: F.struct(e["value"].alias("n"), (-F.array_position(order, e["key"])).alias("k"), e["key"].alias("rule"))))
    told = rows.withColumns({"stripped": stripped, "ratio": ratio, "dominant_rule": first["rule"]})
    return told.withColumn("status", F.when(F.col("ratio") >= R.FAIL, "fail").when(F.col("ratio") >= R.WARN, "warning").otherwise("clean"))


def _query(aggressive: bool, profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = judged(cleaned(table(spark, sf_dir, "documents"), aggressive, profile))
        return rows.select("doc_id", "text", "before", "after", "stripped", F.round("ratio", 6).alias("ratio"), "dominant_rule", "status")

    return run


def hygiene_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by status and dominant rule."""
    return judged(cleaned(table(spark, sf_dir, "documents"))).groupBy("status", "dominant_rule").agg(F.count("*").alias("n"))


def strip_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all texts: words before and taken by each rule, its share, and the texts that it touched."""
    rows = cleaned(table(spark, sf_dir, "documents"))
    total = rows.agg(F.sum("before").alias("before"))
    by = rows.select(F.explode("taken").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("stripped"), F.count("*").alias("files"))
    return by.join(F.broadcast(total)).select("rule", "stripped", "files", F.round(F.col("stripped") / F.col("before"), 6).alias("ratio"))


QUERIES = {
    "prose_hygiene": _query(False, "none"),
    "aggressive_rules": _query(True, "none"),
    **{f"masking_{p}": _query(False, p) for p in R.PROFILES if p != "none"},
    "hygiene_status": hygiene_status,
    "strip_rollup": strip_rollup,
}
