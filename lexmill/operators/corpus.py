"""Corpora: text and weighted rows in, filtered, sampled, normalised and aggregated rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, normalize_column
from ..kernels.text import alternatives
from ..spec import BOUNDARY, RARE, NormalizerSpec


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line of ``text``: ``text``. Lines end with LF only; a null text has none."""
    return df.select(F.explode(F.split(F.col(text), "\n", -1)).alias("text"))


def weighted(df: DataFrame, text: str = "text", freq: str = "freq") -> DataFrame:
    """``text, freq``; a null weight counts as 1, one below 1 is an error."""
    f = F.coalesce(F.col(freq).cast("bigint"), F.lit(1))
    return df.select(F.col(text).alias("text"), F.when(f < 1, F.raise_error(F.concat(F.lit("weight below 1: "), f.cast("string"))).cast("bigint")).otherwise(f).alias("freq"))


def parsed_weights(df: DataFrame, line: str = "value", metadata: bool = False) -> DataFrame:
    """``text, freq`` (and ``meta``) of lines of TAB-separated fields; any other shape is an error."""
    parts = F.split(F.col(line), "\t", -1)
    n = 3 if metadata else 2
    freq = F.try_element_at(parts, F.lit(2)).try_cast("bigint") if hasattr(Column, "try_cast") else F.expr(f"try_cast(split({line}, '\t', -1)[1] as bigint)")
    ok = (F.size(parts) == n) & (freq >= 1)
    if metadata:
        ok = ok & (F.try_element_at(parts, F.lit(3)) != "")
    checked = F.when(F.coalesce(ok, F.lit(False)), freq).otherwise(F.raise_error(F.concat(F.lit("not a weighted line: "), F.col(line))).cast("bigint"))
    cols = [F.element_at(parts, 1).alias("text"), checked.alias("freq")]
    return df.select(*cols, *([F.element_at(parts, 3).alias("meta")] if metadata else []))


def usable(df: DataFrame, longest: int = 4192) -> DataFrame:
    """Rows that training reads: not empty, of at most ``longest`` bytes, without the sign for rare characters."""
    t = F.col("text")
    return df.filter((t != "") & (F.octet_length(t) <= longest) & ~F.contains(t, F.lit(RARE)))


def filter_report(df: DataFrame, longest: int = 4192) -> DataFrame:
    """``reason, n`` of the rows that ``usable`` leaves out, and of those it keeps. A null text counts as empty."""
    t = F.coalesce("text", F.lit(""))
    reason = F.when(t == "", "empty").when(F.octet_length(t) > longest, "too long").when(F.contains(t, F.lit(RARE)), "reserved").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``."""
    return df.orderBy(*order).limit(n)


def sample(df: DataFrame, n: int, seed: int = 12345678, text: str = "text", key: str | None = None) -> DataFrame:
    """n rows by a hash of their key and the seed, the same whatever the partitions.

    Without a key the text is hashed; then equal texts stay together, which a key prevents.
    """
    by = F.col(key or text)
    return df.orderBy(F.xxhash64(F.lit(seed), by), by).limit(n)


def masked(df: DataFrame, symbols: list[str]) -> DataFrame:
    """rows with every occurrence of a symbol, the longest first, replaced by the piece boundary."""
    pattern = alternatives(symbols)
    if pattern is None:
        return df
    ordered = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sorted(set(symbols), key=lambda s: (-len(s), s)))
    return df.withColumn("text", F.regexp_replace("text", ordered, BOUNDARY))


def delimited(df: DataFrame, delimiter: str) -> DataFrame:
    """rows with the pretokenisation delimiter replaced by the piece boundary."""
    return df.withColumn("text", F.replace("text", F.lit(delimiter), F.lit(BOUNDARY)))


def pretokenized(df: DataFrame, split: Column, allow_inconsistent: bool = False) -> DataFrame:
    """rows cut at the boundaries that ``split`` (ARRAY<STRING>) gives; its joined parts must equal the text."""
    joined = F.array_join(split, "")
    text = F.array_join(split, BOUNDARY)
    if allow_inconsistent:
        return df.withColumn("text", text).filter("text <> ''")
    return df.withColumn("text", F.when(joined == F.col("text"), text).otherwise(F.raise_error(F.concat(F.lit("pretokenised text differs: "), F.col("text")))))


def normalized(df: DataFrame, spec: NormalizerSpec, symbols: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``text`` in its normal form; those that become empty are dropped."""
    cheap = filled(F.col("text"), spec, symbols)
    if cheap is not None:  # else the filter would work the normal form out twice
        return df.filter(cheap).withColumn("text", normalize_column("text", spec, symbols))
    return df.withColumn("text", normalize_column("text", spec, symbols)).filter("text <> ''")


def prepared(df: DataFrame, spec: NormalizerSpec, longest: int = 4192) -> DataFrame:
    """``text, meta, freq``: normalised rows, equal ones of equal metadata added up. An over-long row and an overflow are errors."""
    meta = F.col("meta") if "meta" in df.columns else F.lit("")
    t = F.col("text")
    checked = F.when(F.octet_length(t) <= longest, t).otherwise(F.raise_error(F.lit("a row is too long")))
    rows = df.filter("text <> ''").select(checked.alias("text"), F.coalesce(meta, F.lit("")).alias("meta"), F.col("freq").cast("bigint").alias("freq"))
    total = F.sum(F.col("freq").cast("decimal(38,0)"))
    fits = F.when(total <= (1 << 63) - 1, total.cast("bigint")).otherwise(F.raise_error(F.lit("weights overflow")).cast("bigint"))
    return normalized(rows, spec).groupBy("text", "meta").agg(fits.alias("freq"))
