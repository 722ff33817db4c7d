"""Phrases worth an id: mutual information, and removal of those that longer ones absorb."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ABSORPTION
from .ngrams import runs, with_savings
from .ranking import top


def with_pmi(phrases: DataFrame, counts: DataFrame, total: int | None = None) -> DataFrame:
    """``phrases`` (phrase, n, freq) with pmi = log2 freq + (n - 1) log2 total - the sum of its words' log2 counts.

    ``counts`` has token and freq of all tokens, white space too; their sum is the total unless given. A word
    that isn't counted has 1. Phrases of one word, and without any tokens, have 0. Words are joined in one
    shuffle of (phrase, word); the phrase's own columns aren't shuffled with it more than once.
    """
    spark = phrases.sparkSession
    totals = counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total")) if total is None else spark.createDataFrame([(total,)], "total long")
    words = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("token"))
    logs = words.join(counts.select("token", F.col("freq").alias("c")), "token", "left").groupBy("phrase").agg(F.sum(F.log2(F.coalesce("c", F.lit(1)).cast("double"))).alias("logs"))
    pmi = F.log2(F.col("freq").cast("double")) + (F.col("n") - 1) * F.log2(F.col("total").cast("double")) - F.col("logs")
    return phrases.join(logs, "phrase").crossJoin(F.broadcast(totals)).withColumn("pmi", F.when((F.col("n") < 2) | (F.col("freq") <= 0) | (F.col("total") <= 0), 0.0).otherwise(pmi)).drop("logs", "total")


def absorbed(phrases: DataFrame, ratio: float = ABSORPTION) -> DataFrame:
    """phrase, freq and parent_freq of the phrases that a longer one with at least ``ratio`` of their freq contains.

    All are judged at once: an absorbed phrase still absorbs. The greatest parent of each part is taken
    before the join, so a part that many phrases contain is one row.
    """
    inner = phrases.where("n >= 3").select(F.explode(runs(F.split("phrase", " "), 2, 8)).alias("r"), "n", "freq").where("r.n < n")
    parents = inner.groupBy(F.col("r.phrase").alias("phrase")).agg(F.max("freq").alias("parent_freq"))
    return phrases.select("phrase", "freq").join(parents, "phrase").where((F.col("parent_freq") > 0) & (F.col("parent_freq") / F.col("freq") >= ratio))


def with_score(phrases: DataFrame) -> DataFrame:
    """score: what a phrase saves, more by a tenth of its pmi where that is positive."""
    return phrases.withColumn("score", F.col("savings_total") * (1 + F.greatest(F.lit(0.0), F.col("pmi")) / 10))


def mined(grams: DataFrame, counts: DataFrame, min_freq: int, ratio: float = ABSORPTION, min_pmi: float = 0.0) -> DataFrame:
    """Phrases with pmi, savings and score, without those under ``min_pmi`` (if positive) and those absorbed."""
    rows = with_pmi(with_savings(grams, min_freq), counts)
    if min_pmi > 0:
        rows = rows.where(F.col("pmi") >= min_pmi)
    return with_score(rows.join(absorbed(rows, ratio).select("phrase"), "phrase", "left_anti"))


def report(phrases: DataFrame, n: int = 100) -> DataFrame:
    return top(phrases, n, F.desc("score"), F.asc("phrase"))
