"""How often tokens and words occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WORD_IDS
from ..functions import text as T
from .ranking import running, top


def by_freq(key: str = "token") -> list[Column]:
    """Most frequent first, equal ones by code points."""
    return [F.desc("freq"), F.asc(key)]


def token_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """token (lower-cased, of any class) and freq over all rows. Null texts have no tokens."""
    return texts.select(F.explode(T.tokens(column)).alias("token")).groupBy(T.key_of(F.col("token")).alias("token")).agg(F.count("*").alias("freq"))


def first_seen_counts(texts: DataFrame, order: str, column: str = "text") -> DataFrame:
    """The same with first_seen, the least (order, position) of a token: the tie-break of counters filled in order."""
    rows = texts.select(F.col(order).alias("o"), F.posexplode(T.tokens(column)).alias("p", "token"))
    return rows.groupBy(T.key_of(F.col("token")).alias("token")).agg(F.count("*").alias("freq"), F.min(F.struct("o", "p")).alias("first_seen"))


def class_mix(texts: DataFrame, column: str = "text") -> DataFrame:
    """Tokens and distinct lower-cased tokens of each class."""
    counts = token_counts(texts, column)
    return counts.groupBy(T.token_class(F.col("token")).alias("token_class")).agg(F.sum("freq").alias("n_tokens"), F.count("*").alias("n_forms"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_forms"))


def coverage(counts: DataFrame, cuts: tuple[int, ...] = (26, 1000, 4096, 10000)) -> DataFrame:
    """Share of all tokens that the most frequent ones cover, for each cut: cutoff, covered, pct.

    Only as many rows as the largest cut are ever sorted in one task.
    """
    spark = counts.sparkSession
    most = top(counts, max(cuts), *by_freq())
    sums = most.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in cuts], "cutoff int"))).where("rank <= cutoff").groupBy("cutoff").agg(F.sum("freq").alias("covered"))
    return sums.crossJoin(F.broadcast(totals(counts))).select("cutoff", "covered", F.round(F.col("covered") * 100 / F.col("total_tokens"), 4).alias("pct"))


def top_tokens(counts: DataFrame, n: int = 60) -> DataFrame:
    """rank, token as shown, freq, the running sum of freq, and whether it is a word of tier 0."""
    return running(top(counts, n, *by_freq()), "freq", "running", F.asc("rank")).select("rank", T.displayed(F.col("token")).alias("shown"), "freq", "running", F.col("token").isin(*WORD_IDS).alias("in_tier0"))


def missing_tier0(counts: DataFrame, n: int = 60) -> DataFrame:
    """Words of tier 0 that aren't among the ``n`` most frequent tokens, with freq (0: never) and rank (null: never).

    A word's rank is one more than the number of tokens before it: a join with 26 rows and a count, no sort.
    """
    own = counts.sparkSession.createDataFrame([(w,) for w in WORD_IDS], "token string").join(counts, "token", "left")
    few = F.broadcast(own.where("freq is not null").select(F.col("token").alias("word"), F.col("freq").alias("f")))
    ahead = counts.join(few, (F.col("freq") > F.col("f")) | ((F.col("freq") == F.col("f")) & (F.col("token") < F.col("word")))).groupBy("word").agg((F.count("*") + 1).alias("rank"))
    ranks = own.join(ahead, own.token == ahead.word, "left").select("token", F.coalesce("freq", F.lit(0)).alias("freq"), F.when(F.col("freq").isNotNull(), F.coalesce("rank", F.lit(1))).alias("rank"))
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > n))


def surface_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """surface and freq of what stands between white space: two characters or more, not digits alone; case kept."""
    rows = texts.select(F.explode(T.split_words(column)).alias("surface"))
    return rows.where((F.length("surface") >= 2) & ~F.col("surface").rlike(f"^[{T.DIGIT}]+$")).groupBy("surface").agg(F.count("*").alias("freq"))
