"""Filler words and phrases by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FILLER_WEIGHTS, FILLERS
from ..functions import text as T


def lexicon(spark: SparkSession) -> DataFrame:
    """filler, filler_class and n (words) of the fixed lexicon."""
    return spark.createDataFrame([(f, c, f.count(" ") + 1) for c, own in FILLERS.items() for f in own], "filler string, filler_class string, n int")


def weights(spark: SparkSession) -> DataFrame:
    """filler_class, signal and delta of what a filler says of its neighbours."""
    return spark.createDataFrame([(c, s, d) for c, own in FILLER_WEIGHTS.items() for s, d in own.items()], "filler_class string, signal string, delta double")


def occurrences(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, pos (of its first word), filler and filler_class wherever a filler stands in the words of a text.

    At a place the longest filler counts. The lexicon is a few dozen rows and goes to all tasks.
    """
    most = max(f.count(" ") + 1 for own in FILLERS.values() for f in own)
    words = texts.select(key, T.words(column).alias("w"))
    here = lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - k)), lambda n: F.struct(n.alias("n"), k.alias("pos"), F.array_join(F.slice("w", k + 1, n), " ").alias("filler")))
    heads = sorted({f.split(" ")[0] for own in FILLERS.values() for f in own})
    starts = F.filter(F.transform("w", lambda x, k: F.when(x.isin(*heads), k)), lambda k: k.isNotNull())
    spans = words.select(key, F.explode(F.flatten(F.transform(starts, here))).alias("s")).select(key, "s.*")
    found = spans.join(F.broadcast(lexicon(texts.sparkSession)).drop("n"), "filler")
    return found.groupBy(key, "pos").agg(F.max_by(F.struct("filler", "filler_class"), "n").alias("f")).select(key, "pos", "f.filler", "f.filler_class")


def class_counts(texts: DataFrame) -> DataFrame:
    return occurrences(texts).groupBy("filler_class").agg(F.count("*").alias("n"))
