"""The word library: lemmas, ids by rank, vectors, their projection on poles, stages, and search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BASE64, CAPACITY, FIRST, LIBRARY_RANKS, ROLES, STAGES
from ..functions.ids import encoded_id
from ..functions.vectors import clipped, dot, nearest, norm, normalised
from .ranking import ranked

#: Vectors of the query or pole side that are sent to all tasks at once.
MOST_SENT = 10_000


def role_of(pos: Column) -> Column:
    """The role of a part of speech; other for one that has none, and for null."""
    out = F.lit("other")
    for name, role in ROLES.items():
        out = F.when(pos == name, role).otherwise(out)
    return out


def lemmas(surfaces: DataFrame, analysed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """lemma, frequency, pos_tag, role, surface (the most frequent) and surfaces of all surfaces, or the ``most`` most frequent.

    ``surfaces`` has surface and freq, ``analysed`` (surface, lemma, pos) what an analyser says of them; without
    it a surface is its own lemma. Only lemmas of letters alone are kept.
    """
    few = surfaces if most is None else surfaces.orderBy(F.desc("freq"), F.asc("surface")).limit(most)
    rows = few.withColumn("lemma", F.lower("surface")).withColumn("pos", F.lit(None).cast("string")) if analysed is None else few.join(analysed.select("surface", F.lower("lemma").alias("lemma"), "pos"), "surface")
    first = F.struct((-F.col("freq")).alias("f"), "surface")
    found = rows.where(F.col("surface").rlike(r"^\p{L}+$")).groupBy("lemma").agg(F.sum("freq").alias("frequency"), F.min_by("pos", first).alias("pos_tag"), F.min_by("surface", first).alias("surface"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x.surface).alias("surfaces"))
    return found.select("lemma", "frequency", "pos_tag", role_of(F.col("pos_tag")).alias("role"), "surface", "surfaces")


def with_ids(words: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """``words`` (lemma, frequency) with tier by rank and id: the next number of the tier whose id isn't in ``registered`` (id).

    Numbers already taken are skipped: the free ones, ranked, are joined by rank; a tier without any left is an error. Only as many numbers as there
    are words and registered ids are ever looked at.
    """
    first, second = LIBRARY_RANKS
    place = ranked(words, "place", F.desc("frequency"), F.asc("lemma"))
    tiered = place.withColumn("tier", F.when(F.col("place") < first, 1).when(F.col("place") < second, 2).otherwise(3)).withColumn("k", F.col("place") - F.when(F.col("place") < first, 0).when(F.col("place") < second, first).otherwise(second))
    if registered is None:
        return tiered.withColumn("id", encoded_id(F.col("tier"), F.col("k"))).drop("place", "k")
    spark = words.sparkSession
    value = lambda i: F.position(F.substring("id", i, 1), F.lit(BASE64)) - 1
    size = F.length("id")
    number = F.when(size == 2, value(2)).when(size == 3, value(2) * 64 + value(3)).otherwise(value(2) * 4096 + value(3) * 64 + value(4)) + (F.position(F.substring("id", 1, 1), F.lit(FIRST)) - 1) * F.pow(F.lit(64), size - 1).cast("long")
    taken = registered.where(size.between(2, 4) & F.substring("id", 1, 1).isin(*FIRST)).select((size - 1).alias("tier"), number.cast("long").alias("number")).distinct()
    n_words, n_taken = words.count(), taken.count()
    free = None
    for tier, most in CAPACITY.items():
        need = min(most, n_words + n_taken)
        own = spark.range(need).select(F.col("id").alias("number")).join(taken.where(F.col("tier") == tier).select("number"), "number", "left_anti")
        own = ranked(own, "k", F.asc("number")).withColumn("tier", F.lit(tier))
        free = own if free is None else free.unionByName(own)
    id_ = F.when(F.col("number").isNotNull(), encoded_id(F.col("tier"), F.col("number"))).otherwise(F.raise_error(F.lit("a tier has no free id left")))
    return tiered.join(free, ["tier", "k"], "left").withColumn("id", id_).drop("place", "k", "number")


def embedded(words: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``words`` with the normalised vector that ``model`` gives for a batch of lemmas."""

    @F.pandas_udf("array<float>")
    def vectors(lemma: pd.Series) -> pd.Series:
        return pd.Series(model(lemma.tolist()))

    return words.withColumn("embedding", vectors("lemma")).withColumn("embedding", normalised(F.col("embedding")).cast("array<float>"))


def poles(seeds: DataFrame) -> DataFrame:
    """pole and axis: the normalised mean of the normalised vectors of each pole (rows of pole and embedding).

    Means are taken by dimension, so a pole with many seeds isn't gathered.
    """
    rows = seeds.where("pole is not null and embedding is not null").select("pole", F.posexplode(normalised(F.col("embedding"))).alias("d", "x"))
    means = rows.groupBy("pole", "d").agg(F.avg("x").alias("x")).groupBy("pole").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("axis"))
    return means.select("pole", normalised(F.col("axis")).alias("axis"))


def projected(vectors: DataFrame, axes: DataFrame, pairs: dict[str, tuple]) -> DataFrame:
    """``vectors`` with a column for each of ``pairs``: likeness to its first pole less that to its second, within -1 and 1."""
    names = sorted({p for pair in pairs.values() for p in pair})
    wide = axes.groupBy().pivot("pole", names).agg(F.first("axis"))
    wide = wide.toDF(*[f"_axis{k}" for k in range(len(names))])
    of = {p: F.col(f"_axis{k}") for k, p in enumerate(names)}
    unit = normalised(F.col("embedding"))
    rows = vectors.withColumn("_unit", unit).crossJoin(F.broadcast(wide))
    return rows.select(*vectors.columns, *[clipped(dot(F.col("_unit"), of[a]) - dot(F.col("_unit"), of[b])).alias(name) for name, (a, b) in pairs.items()])


def stage_of(e: Column, p: Column, a: Column) -> Column:
    """The stage whose centre is nearest, the first of equal ones; null if a coordinate is null."""
    distance = lambda c: F.sqrt((e - c[0]) * (e - c[0]) + (p - c[1]) * (p - c[1]) + (a - c[2]) * (a - c[2]))
    return nearest([(name, distance(centre)) for name, centre in STAGES.items()])


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score and rank of the ``k`` vectors with the greatest inner product with each query, exact.

    ``queries`` are set against all vectors in blocks of MOST_SENT, each sent to all tasks; equal scores go by
    vec_id. Spark's rank limit keeps the ``k`` best of each task before the shuffle. Null vectors match nothing.
    """
    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    asked = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    n = asked.count()
    blocks = [asked] if n <= MOST_SENT else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // MOST_SENT) * 2)) == b) for b in range(-(-n // MOST_SENT) * 2)]
    out = None
    for block in blocks:
        scores = rows.crossJoin(F.broadcast(block)).select("query_id", "vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        own = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def lengths(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"))
