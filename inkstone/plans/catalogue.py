"""The catalogue of queries: relations and query bodies, planned on Spark and written out as SQL for the oracle.

A relation is a named DataFrame builder (tokens, sentences, ...) or a body of its own; a body names what it reads in
braces. On Spark each relation becomes a temporary view over a lazy plan, so Catalyst sees one plan from scan to result;
for the oracle the same names become common table expressions.

Few functions differ between the engines; a body writes them as @NAME(a;;b).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.plans.shared import written
from inkstone.sources.tables import TABLES, table

BUILDERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
RELATIONS: dict[str, str] = {}
PLANNED: dict[str, str] = {}  # bodies that Spark plans in place of a relation's or a query's SQL
WRITTEN: set[str] = set()
BODIES: dict[str, str] = {}
_NAMES = itertools.count()
_READS = re.compile(r"\{([a-z]\w*)\}")


def _spark_text(s: str) -> str:
    return 'r"' + s.replace('"', r"\x22") + '"'


def _duck_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPARK = {
    "RE": lambda p: _spark_text(p),
    "COUNT": lambda e, p: f"CAST(regexp_count({e}, {_spark_text(p)}) AS BIGINT)",
    "SUB": lambda e, p, r: f"regexp_replace({e}, {_spark_text(p)}, {_spark_text(r)})",
    "MATCH": lambda e, p: f"({e} RLIKE {_spark_text(p)})",
    "FIRST": lambda e, p: f"regexp_extract({e}, {_spark_text(p)}, 0)",
    "GROUP": lambda e, p: f"regexp_extract({e}, {_spark_text(p)}, 1)",
    "ALL": lambda e, p: f"regexp_extract_all({e}, {_spark_text(p)}, 0)",
    "PARTS": lambda e, mark: f"split({e}, '{mark}', -1)",
    "NUMBERED": lambda a, k, x: f"posexplode({a}) AS ({k}, {x})",
    "UNNEST": lambda a, b: f"explode(sequence({a}, {b}))",
    "COUNTIN": lambda a, p: f"CAST(size(filter({a}, x -> x RLIKE {_spark_text(p)})) AS BIGINT)",
    "JOINED": lambda a: f"array_join({a}, ' ')",
    "DISTINCT": lambda a: f"array_distinct({a})",
    "SHARED": lambda a, b: f"CAST(size(array_intersect({a}, {b})) AS BIGINT)",
    "SIZE": lambda a: f"CAST(size({a}) AS BIGINT)",
    "PCT": lambda x, q: f"percentile({x}, {q})",
    "ARR": lambda *xs: f"array({', '.join(xs)})",
    "PAIR": lambda a, b: f"struct({a}, {b})",
    "SHA": lambda x: f"sha2({x}, 256)",
    "DAYS": lambda x: f"CAST(to_date({x}) AS STRING)",
    "MONTH": lambda x: f"date_format({x}, 'yyyy-MM')",
    "EPOCH": lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))",
    "MOD32": lambda x, n: f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT) % {n}",
}
_DUCK = {
    "RE": lambda p: _duck_text(p),
    "COUNT": lambda e, p: f"CAST(len(regexp_extract_all({e}, {_duck_text(p)})) AS BIGINT)",
    "SUB": lambda e, p, r: f"regexp_replace({e}, {_duck_text(p)}, {_duck_text(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], r))}, 'g')",
    "MATCH": lambda e, p: f"regexp_matches({e}, {_duck_text(p)})",
    "FIRST": lambda e, p: f"regexp_extract({e}, {_duck_text(p)})",
    "GROUP": lambda e, p: f"regexp_extract({e}, {_duck_text(p)}, 1)",
    "ALL": lambda e, p: f"regexp_extract_all({e}, {_duck_text(p)})",
    "PARTS": lambda e, mark: f"string_split({e}, '{mark}')",
    "NUMBERED": lambda a, k, x: f"unnest(range(len({a}))) AS {k}, unnest({a}) AS {x}",
    "UNNEST": lambda a, b: f"unnest(range({a}, {b} + 1))",
    "COUNTIN": lambda a, p: f"CAST(len(list_filter({a}, lambda x: regexp_matches(x, {_duck_text(p)}))) AS BIGINT)",
    "JOINED": lambda a: f"coalesce(list_aggregate({a}, 'string_agg', ' '), '')",
    "DISTINCT": lambda a: f"list_distinct({a})",
    "SHARED": lambda a, b: f"CAST(len(list_intersect({a}, {b})) AS BIGINT)",
    "SIZE": lambda a: f"CAST(len({a}) AS BIGINT)",
    "PCT": lambda x, q: f"quantile_cont({x}, {q})",
    "ARR": lambda *xs: f"[{', '.join(xs)}]",
    "PAIR": lambda a, b: f"{{{repr(a)}: {a}, {repr(b)}: {b}}}",
    "SHA": lambda x: f"sha256({x})",
    "DAYS": lambda x: f"CAST(CAST({x} AS DATE) AS VARCHAR)",
    "MONTH": lambda x: f"strftime({x}, '%Y-%m')",
    "EPOCH": lambda x: f"CAST(epoch_us({x}) AS BIGINT)",
    "MOD32": lambda x, n: f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % {n}",
}
_CALL = re.compile(r"@([A-Z0-9]+)\(")


def render(sql: str, names: dict[str, Callable]) -> str:
    """sql with each @NAME(...) written for one engine; innermost first."""
    while calls := list(_CALL.finditer(sql)):
        call = calls[-1]
        i = call.end()
        # arguments are split at ';;'; a call ends at ')@', as patterns may hold brackets of their own
        end = sql.find(")@", i)
        args = sql[i:end].split(";;")
        sql = sql[: call.start()] + names[call[1]](*args) + sql[end + 2 :]
    return sql


_DECIMAL = re.compile(r"(?<![\w.'])(\d+[.]\d+)(?![\w.'])")


def _doubles(sql: str) -> str:
    """Decimal literals outside of quotes as doubles, which is what division gives in the other engine."""
    parts = sql.split("'")
    return "'".join(_DECIMAL.sub(r"\1D", p) if i % 2 == 0 else p for i, p in enumerate(parts))


def _counts(sql: str) -> str:
    """count_if(x) as a filtered count, which is a BIGINT and never NULL."""
    while (i := sql.find("count_if(")) >= 0:
        j, depth, quoted = i + 9, 1, False
        while depth:
            quoted ^= sql[j] == "'"
            depth += 0 if quoted else (sql[j] == "(") - (sql[j] == ")")
            j += 1
        sql = sql[:i] + "count(*) FILTER (WHERE " + sql[i + 9 : j - 1] + ")" + sql[j:]
    return sql


def builder(name: str, duck: str, written: bool = False):
    """written: as of a relation."""

    def keep(f):
        BUILDERS[name] = (f, duck)
        if written:
            WRITTEN.add(name)
        return f

    return keep


def relation(name: str, body: str, spark: str | None = None, written: bool = False) -> None:
    """spark: another body for the same rows, where Spark has a better plan; the oracle keeps the SQL, so that each checks the other.
    written: what reads the relation several times reads a table in the shared folder, so that it is worked out once."""
    RELATIONS[name] = body
    if written:
        WRITTEN.add(name)
    if spark is not None:
        PLANNED[name] = spark


def query(name: str, body: str, spark: str | None = None) -> None:
    """spark: as of a relation."""
    BODIES[name] = body
    if spark is not None:
        PLANNED[f"query {name}"] = spark


def _frame(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    if name in tables:
        return tables[name]
    if name in BUILDERS:
        rows = BUILDERS[name][0](spark, sf_dir)
    elif name in RELATIONS:
        rows = run(spark, sf_dir, PLANNED.get(name, RELATIONS[name]), tables)
    else:
        return table(spark, sf_dir, name)
    if name in WRITTEN:
        rows = tables[name] = written(rows)
    return rows


def run(spark: SparkSession, sf_dir: str, body: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """tables: written relations by name, which all bodies of one query share."""
    views, tables = {}, {} if tables is None else tables
    for name in dict.fromkeys(_READS.findall(body)):
        views[name] = f"inkstone_{name}_{next(_NAMES)}"
        _frame(spark, sf_dir, name, tables).createOrReplaceTempView(views[name])
    return spark.sql(render(_READS.sub(lambda m: views[m[1]], _doubles(body)), _SPARK))


def oracle(body: str) -> str:
    """The body for DuckDB, with the relations it reads as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in _READS.findall(RELATIONS.get(name, "")) if name in RELATIONS else ():
            visit(n)
        order.append(name)

    for name in _READS.findall(body):
        visit(name)
    text = lambda b: _counts(render(_READS.sub(lambda m: m[1], b), _DUCK))
    parts = [f"{n} AS MATERIALIZED ({BUILDERS[n][1] if n in BUILDERS else text(RELATIONS[n])})" for n in order]
    body = text(body).strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, b=PLANNED.get(f"query {n}", b): run(spark, sf_dir, b)) for n, b in BODIES.items()}


def oracles() -> dict[str, str]:
    return {n: oracle(b) for n, b in BODIES.items()}
