"""The dictionary: surfaces, their Base64 ids by tier, and integer ids with their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BYTE_IDS, CAPACITY, FORCED, MARK_IDS, MIN_FREQ, PROFILES, SPECIAL_TOKENS, SYSTEM_IDS, TIER0_IDS, TIER1_RESERVE, WORD_IDS
from ..functions.ids import encoded_id, slot_tier
from .ranking import ranked

#: Columns of a dictionary. int_id is null for a forced entry that never occurs.
COLUMNS = ["surface", "base64_id", "tier", "freq", "kind", "int_id"]


def _seeds(counts: DataFrame) -> DataFrame:
    """Entries of tier 0 with their freq (0: never)."""
    rows = counts.sparkSession.createDataFrame(list(TIER0_IDS.items()), "surface string, base64_id string")
    return F.broadcast(rows).join(counts.select(F.col("token").alias("surface"), "freq"), "surface", "left").select("surface", "base64_id", F.lit(0).alias("tier"), F.coalesce("freq", F.lit(0)).alias("freq"), F.lit("tier0").alias("kind"))


def _forced(counts: DataFrame) -> DataFrame:
    rows = counts.sparkSession.createDataFrame([(t, k) for k, t in enumerate(FORCED)], "surface string, slot int")
    ids = rows.select("surface", encoded_id(F.lit(1), F.col("slot")).alias("base64_id"))
    return F.broadcast(ids).join(counts.select(F.col("token").alias("surface"), "freq"), "surface", "left").select("surface", "base64_id", F.lit(1).alias("tier"), F.coalesce("freq", F.lit(0)).alias("freq"), F.lit("word").alias("kind"))


def _with_ids(ordered: DataFrame) -> DataFrame:
    """Ids by ``place`` (from 0) after the forced entries; places beyond the last tier have none and fall away."""
    tier, counter = slot_tier(F.col("place") + len(FORCED))
    return ordered.withColumn("tier", tier).withColumn("counter", counter).where("tier is not null").select("surface", encoded_id(F.col("tier"), F.col("counter")).alias("base64_id"), "tier", "freq", "kind")


def words_dictionary(counts: DataFrame) -> DataFrame:
    """surface, base64_id, tier, freq and kind of all tokens by freq: tier 0, forced entries, then tiers 1 to 3 in order.

    ``counts`` has token and freq; equal freqs go by code points. Tokens beyond the tiers' capacity have no entry.
    """
    rest = counts.where(~F.col("token").isin(*TIER0_IDS, *FORCED)).select(F.col("token").alias("surface"), "freq", F.lit("word").alias("kind"))
    ids = _with_ids(ranked(rest, "place", F.desc("freq"), F.asc("surface")))
    return _seeds(counts).unionByName(_forced(counts)).unionByName(ids)


def dictionary(counts: DataFrame, phrases: DataFrame, min_freq: int = MIN_FREQ, reserve: int = TIER1_RESERVE, drop_tier0_bigrams: bool = True) -> DataFrame:
    """The dictionary of words and phrases, with integer ids by freq over all entries.

    ``phrases`` has phrase, n and freq. A phrase that is also a token falls away, and (unless switched off) two
    words of tier 0, which save nothing. The ``reserve`` most frequent words come first, then words and phrases
    by freq. Of equal freqs tier 0 comes first, words before phrases, then code points. A forced entry rarer
    than ``min_freq`` has no integer id.
    """
    words = counts.where((F.col("freq") >= min_freq) & ~F.col("token").isin(*TIER0_IDS)).select(F.col("token").alias("surface"), "freq", F.lit("word").alias("kind"))
    fine = phrases.where(F.col("freq") >= min_freq)
    if drop_tier0_bigrams:
        fine = fine.where(~((F.col("n") == 2) & F.forall(F.split("phrase", " "), lambda w: w.isin(*TIER0_IDS))))
    pool = fine.join(counts.select(F.col("token").alias("phrase")), "phrase", "left_anti").select(F.col("phrase").alias("surface"), "freq", F.lit("phrase").alias("kind"))
    first = words.orderBy(F.desc("freq"), F.asc("surface")).limit(reserve).select("surface", F.lit(True).alias("first"))
    words = words.join(F.broadcast(first), "surface", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    entries = words.unionByName(pool.withColumn("first", F.lit(False)))
    kind = F.when(F.col("kind") == "tier0", 0).when(F.col("kind") == "word", 1).otherwise(2)
    placed = ranked(entries.where(~F.col("surface").isin(*FORCED)), "place", F.desc("first"), F.desc("freq"), kind.asc(), F.asc("surface"))
    ids = _seeds(counts).unionByName(_with_ids(placed)).unionByName(_forced(counts))
    counted = ids.where(~F.col("surface").isin(*FORCED) | (F.col("freq") >= min_freq))
    numbered = ranked(counted, "int_id", F.desc("freq"), kind.asc(), F.asc("surface"))
    return numbered.select(COLUMNS).unionByName(ids.join(numbered.select("surface"), "surface", "left_anti").withColumn("int_id", F.lit(None).cast("long")).select(COLUMNS))


def tier_coverage(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries and share of all tokens, in percent, by tier; tier null is what has no entry."""
    both = counts.join(entries.select(F.col("surface").alias("token"), "tier"), "token", "full")
    total = F.broadcast(counts.agg(F.sum("freq").alias("total")))
    return both.groupBy("tier").agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_tokens")).crossJoin(total).select("tier", "n_entries", "n_tokens", F.round(F.col("n_tokens") * 100 / F.col("total"), 4).alias("pct"))


def kind_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count("*").alias("n_entries"), F.sum("freq").alias("freq"))


def profile_cuts(spark: SparkSession, content: DataFrame | int) -> DataFrame:
    """profile, content_size, byte_fallback_start, special_tokens_start and total_vocab of the five profiles.

    ``content`` is the number of entries with integer ids, or a table of one row with it.
    """
    total = spark.createDataFrame([(content,)], "n long") if isinstance(content, int) else content.toDF("n")
    sizes = spark.createDataFrame([(k, name, size) for k, (name, size) in enumerate(PROFILES.items())], "place int, profile string, size long")
    cut = F.least(F.coalesce("size", "n"), F.col("n"))
    return sizes.crossJoin(F.broadcast(total)).select("place", "profile", cut.alias("content_size"), cut.alias("byte_fallback_start"), (cut + BYTE_IDS).alias("special_tokens_start"), (cut + BYTE_IDS + len(SPECIAL_TOKENS)).alias("total_vocab"))


def content_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("int_id").alias("n"))


def special_tokens(cuts: DataFrame) -> DataFrame:
    """profile, name and id of the special tokens at the end of each profile."""
    return cuts.select("profile", "special_tokens_start", F.posexplode(F.array(*map(F.lit, SPECIAL_TOKENS))).alias("k", "name")).select("profile", "name", (F.col("special_tokens_start") + F.col("k")).alias("id"))


def byte_fallback(cuts: DataFrame) -> DataFrame:
    """byte_value, hex and the id of each byte in each profile: 256 rows."""
    spark = cuts.sparkSession
    wide = cuts.groupBy().pivot("profile", list(PROFILES)).agg(F.first("byte_fallback_start"))
    rows = spark.range(BYTE_IDS).select(F.col("id").alias("byte_value"), F.concat(F.lit("0x"), F.lpad(F.hex("id"), 2, "0")).alias("hex"))
    return rows.crossJoin(F.broadcast(wide)).select("byte_value", "hex", *[(F.col(p) + F.col("byte_value")).alias(f"id_in_{p}") for p in PROFILES])


def token_ids(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """Entries by integer id with Y or N for each profile that has them."""
    wide = cuts.groupBy().pivot("profile", list(PROFILES)).agg(F.first("content_size"))
    rows = entries.where("int_id is not null").crossJoin(F.broadcast(wide))
    flag: list[Column] = [F.when(F.col("int_id") < F.col(p), "Y").otherwise("N").alias(p) for p in ("tiny", "compact", "standard", "full")]
    return rows.select(F.col("int_id").alias("id"), "base64_id", "surface", "tier", "freq", "kind", *flag)


def in_profile(entries: DataFrame, size: int) -> DataFrame:
    """The entries of a profile of any size."""
    return entries.where(F.col("int_id") < size)


def essentials(counts: DataFrame, entries: DataFrame) -> DataFrame:
    """The 58 ids of one character with freq (0: never), integer id (null: none) and their profiles."""
    rows = [(c, s, kind) for kind, own in (("system", SYSTEM_IDS), ("word", {v: k for k, v in WORD_IDS.items()}), ("structural", {v: k for k, v in MARK_IDS.items()})) for c, s in own.items()]
    base = F.broadcast(counts.sparkSession.createDataFrame(rows, "char_id string, surface string, category string"))
    with_freq = base.join(counts.select(F.col("token").alias("surface"), "freq"), "surface", "left")
    both = F.broadcast(with_freq).join(entries.select("surface", "int_id"), "surface", "left")
    return both.select("char_id", "surface", "category", F.coalesce("freq", F.lit(0)).alias("freq"), F.col("int_id").alias("integer_id"), *[F.lit("Y").alias(f"profile_{p}") for p in PROFILES])


def spot_check(entries: DataFrame, surfaces: list[str]) -> DataFrame:
    """Each surface's id, and the surface of that id: null where there is none."""
    asked = F.broadcast(entries.sparkSession.createDataFrame([(s,) for s in surfaces], "asked string"))
    forward = asked.join(entries, F.lower("asked") == F.col("surface"), "left").select("asked", "base64_id", "tier")
    return F.broadcast(forward).join(entries.select("base64_id", F.col("surface").alias("found")), "base64_id", "left").select("asked", "base64_id", "tier", "found")


def stats(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of what the dictionary holds and covers."""
    held = entries.agg(F.count("*").alias("total_entries"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}_count") for t in range(4)], F.count_if(F.col("kind") != "phrase").alias("words_in_dict"), F.count_if(F.col("kind") == "phrase").alias("phrases_in_dict"), F.sum(F.when(F.col("kind") != "phrase", F.col("freq"))).alias("covered"))
    total = counts.agg(F.sum("freq").alias("total_tokens"), F.count("*").alias("unique_forms"))
    return held.crossJoin(total).select("*", F.round(F.col("covered") * 100 / F.col("total_tokens"), 4).alias("coverage_pct"), F.greatest(F.lit(0), F.col("unique_forms") - sum(CAPACITY.values())).alias("overflow_bound"))


def profile_encoded(tokens: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """doc_id, pos, sub and id of each token: its integer id if the profile has it, else an id for each of its bytes.

    ``tokens`` has doc_id, pos and token. A forced entry without integer id goes by its bytes too.
    """
    own = in_profile(entries, size).select("surface", "int_id")
    both = tokens.join(own, F.col("token") == F.col("surface"), "left")
    hexed = F.hex(F.encode("token", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda k: F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("long") + size)
    return both.select("doc_id", "pos", F.posexplode(F.when(F.col("int_id").isNotNull(), F.array("int_id")).otherwise(as_bytes)).alias("sub", "id"))
