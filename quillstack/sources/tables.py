"""Tables of counts, phrases and dictionaries as text files, and read again."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked


def escaped(token: Column | str) -> Column:
    """Tokens with everything outside printable ASCII as backslash escapes."""

    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: t.encode("unicode_escape").decode("ascii"))

    return run(token)


def unescaped(token: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: codecs.decode(t, "unicode_escape"))

    return run(token)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value != '' and not startswith(value, '#')")


def write_frequencies(counts: DataFrame, path: str) -> None:
    """Lines of freq, tab, escaped token, the most frequent first, in files that follow one another; the first begins with lines headed by #."""
    totals = counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.count("*").alias("forms"))
    head = totals.select(F.explode(F.array(F.lit("# token counts"), F.concat(F.lit("# total tokens: "), "total"), F.concat(F.lit("# unique forms: "), "forms"), F.lit("# freq\ttoken"))).alias("value"))
    rows = counts.orderBy(F.desc("freq"), F.asc("token"))
    lines = rows.select(F.concat_ws("\t", F.col("freq").cast("string"), escaped("token")).alias("value"))
    head.unionByName(lines).write.mode("overwrite").text(path)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """token and freq; lines that have no tab fall away."""
    part = F.split("value", "\t", 2)
    return _lines(spark, path).where(F.col("value").contains("\t")).select(unescaped(F.get(part, 1)).alias("token"), F.get(part, 0).cast("long").alias("freq"))


def _ranked_lines(rows: DataFrame, order: str, columns: list) -> DataFrame:
    place = ranked(rows, "place", F.desc(order), F.asc("phrase"))
    return place.orderBy("place").select(F.concat_ws("\t", (F.col("place") + 1).cast("string"), *columns).alias("value"))


def write_ngrams(scored: DataFrame, path: str) -> None:
    """Lines of rank, n, freq, savings_each, savings_total and phrase."""
    columns = [F.col("n").cast("string"), F.col("freq").cast("string"), F.format_string("%.2f", "savings_each"), F.col("savings_total").cast("long").cast("string"), F.col("phrase")]
    _ranked_lines(scored, "savings_total", columns).write.mode("overwrite").text(path)


def read_ngrams(spark: SparkSession, *paths: str) -> DataFrame:
    """n, phrase and freq of files of runs, one after another; short lines fall away."""
    out = None
    for path in paths:
        part = F.split("value", "\t")
        rows = _lines(spark, path).where(F.size(part) >= 6).select(F.get(part, 1).cast("int").alias("n"), F.get(part, 5).alias("phrase"), F.get(part, 2).cast("long").alias("freq"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "n int, phrase string, freq long")


def write_phrases(mined: DataFrame, path: str) -> None:
    """Lines of rank, n, freq, pmi, savings_each, savings_total, score and phrase."""
    columns = [F.col("n").cast("string"), F.col("freq").cast("string"), F.format_string("%.2f", "pmi"), F.format_string("%.2f", "savings_each"), F.col("savings_total").cast("long").cast("string"), F.format_string("%.1f", "score"), F.col("phrase")]
    _ranked_lines(mined, "score", columns).write.mode("overwrite").text(path)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase, n, freq and pmi; lines of fewer than 8 fields fall away."""
    part = F.split("value", "\t")
    return _lines(spark, path).where(F.size(part) >= 8).select(F.get(part, 7).alias("phrase"), F.get(part, 1).cast("int").alias("n"), F.get(part, 2).cast("long").alias("freq"), F.get(part, 3).cast("double").alias("pmi"))


def write_dictionary(entries: DataFrame, path: str) -> None:
    """Replaces the dictionary at ``path``; one table serves both directions."""
    entries.write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_token_ids(rows: DataFrame, path: str) -> None:
    rows.orderBy("id").write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').option("quoteAll", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A small table as one file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A small table as one file of JSON lines: profile cuts, special tokens, statistics, benchmarks."""
    rows.coalesce(1).write.mode("overwrite").json(path)
