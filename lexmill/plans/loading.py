"""Queries over raw corpus lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from ..sources.rejects import load_lines


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "refrow_raw").select("raw_id", "raw_line"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter("reason is not null").select("raw_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter("reason is null").select("raw_id", "text", "weight", "meta")


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter("reason is not null").select("raw_id", "reason", "raw_line")


QUERIES = {f.__name__: f for f in (p4_found, p4_loaded, p4_rejected)}

FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
CHECKED = f"""
with f as (select raw_id, raw_line, regexp_full_match(raw_line, '{FIELD}(?:\\t{FIELD})*', 's') quoted, regexp_full_match(raw_line, '{FIELD}\\t{FIELD}\\t{FIELD}', 's') three,
             regexp_extract(raw_line, '^({FIELD})\\t({FIELD})\\t({FIELD})$', ['t', 'w', 'm'], 's') x from refrow_raw),
u as (select raw_id, raw_line, quoted, three, case when x.t like '"%' then replace(x.t[2:-2], '""', '"') else x.t end t, case when x.w like '"%' then replace(x.w[2:-2], '""', '"') else x.w end w, case when x.m like '"%' then replace(x.m[2:-2], '""', '"') else x.m end m from f),
c as (select raw_id, raw_line, t, w, m, case when raw_line is null then 'columns' when not quoted then 'quoting' when not three then 'columns'
  when not regexp_matches(t, '[^\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}\\v]') or not regexp_full_match(w, '[0-9]+') or length(ltrim(w, '0')) not between 1 and 19 or try_cast(w as hugeint) > 9223372036854775807 then 'invalid_value' end reason from u)"""
SQL = {
    "p4_found": f"{CHECKED} select raw_id, reason from c where reason is not null",
    "p4_rejected": f"{CHECKED} select raw_id, reason, raw_line from c where reason is not null",
    "p4_loaded": f"{CHECKED} select raw_id, t as text, cast(w as bigint) as weight, m as meta from c where reason is null",
}
