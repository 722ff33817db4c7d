"""Problem 7: mixing sources to target weights.

Capped water-filling decides the tokens of each source: what a source can't give within its cap goes to
the others in proportion to their weights, until nothing is over its cap. Each document is then taken a
whole number of times, and a seeded sample once more. The sample is a prefix of the source in the order
of a hash, found by summing 4096 ranges of the hash, so that no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.scratch import table, written
from .bpe import TOKENIZERS, token_counts

BUCKETS = 4096
#: Rows of a plan up to which it is sent to all tasks; a larger one is joined by a shuffle.
MOST_SENT = 50_000
SEED = 7


def plain_source(source: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores: how sources are compared and given."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def water_filled(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """``rows`` (``by``, weight, cap, budget) with tokens: in proportion to weight, none over its cap, in all budget or all caps.

    Clamping what is over and sharing out the rest anew ends at one level: tokens for a weight of 1. A source is clamped if
    the level reaches cap / weight, and it does if all sources, filled up to there, take no more than the budget. So sources
    in that order, with running sums of caps and weights, give in one go what the rounds would. A group is a run's targets.
    """
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    upto = Window.partitionBy(by).orderBy("_ratio").rangeBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    own = rows.withColumn("_ratio", ratio)
    finite = F.when(F.col("_ratio") < inf, F.col("cap")).otherwise(0.0)
    weight = F.when(F.col("_ratio").isNotNull(), F.col("weight")).otherwise(0.0)
    sums = own.withColumn("_caps", F.sum(finite).over(upto)).withColumn("_left", F.sum(weight).over(every) - F.sum(weight).over(upto))
    need = F.when(F.col("_ratio") < inf, F.col("_caps") + F.col("_ratio") * F.greatest(F.lit(0.0), F.col("_left")))
    marked = sums.withColumn("_clamped", F.coalesce(need <= F.col("budget"), F.lit(False)))
    level = (F.col("budget") - F.sum(F.when(F.col("_clamped"), F.col("cap")).otherwise(0.0)).over(every)) / F.sum(F.when(~F.col("_clamped"), weight).otherwise(0.0)).over(every)
    filled = F.when(F.col("_ratio").isNull(), 0.0).when(F.col("_clamped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return marked.withColumn("tokens", filled).drop("_ratio", "_caps", "_left", "_clamped")


class Mixture:
    """Documents with their sizes in the tokens of each run's tokenizer, and the plan of each run and source.

    Null and empty texts have no tokens and are never chosen; documents without source belong to no
    target but count in the budget. ``documents`` has doc_id (unique), text and source. A source named twice in a run
    has the sum of its weights and the smaller cap; a null or negative weight is 0, a null cap none; sources without
    documents, or null, give nothing and leave their share to the others. Runs and targets may have any number of rows.
    """

    def __init__(self, documents: DataFrame, runs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> None:
        self.spark = documents.sparkSession
        plain = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text")
        names = sorted(r.tokenizer for r in runs.where("tokenizer is not null").select("tokenizer").distinct().collect())  # as many as vocabularies
        sized = self.spark.createDataFrame([], "doc_id long, source string, n_tokens long, tokenizer string")
        for name in names:
            sized = sized.unionByName(token_counts(plain, name, folder).withColumn("tokenizer", F.lit(name)))
        self.sized = written(sized, "sized")
        sizes = self.sized.groupBy("tokenizer", "source").agg(F.sum("n_tokens").alias("available"), F.max("n_tokens").alias("largest"))
        sizes = written(sizes, "sizes")
        totals = sizes.groupBy("tokenizer").agg(F.sum("available").alias("total"))
        own = targets.where("source is not null").groupBy("run_id", plain_source(F.col("source")).alias("source")).agg(F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))).alias("weight"), F.min("max_repeats").alias("most"))
        rows = own.join(runs.select("run_id", "budget_share", "tokenizer"), "run_id").join(totals, "tokenizer", "left").join(sizes, ["tokenizer", "source"], "left").na.fill(0, ["total", "available", "largest"])
        cap = F.when(F.col("available") > 0, F.coalesce(F.col("most").cast("double"), F.lit(float("inf"))) * F.col("available")).otherwise(0.0)
        filled = water_filled(rows.withColumn("cap", cap).withColumn("budget", F.col("budget_share") * F.col("total")))
        all_ = F.sum("weight").over(Window.partitionBy("run_id"))
        whole = F.when(F.col("available") > 0, F.floor(F.col("tokens") / F.col("available"))).otherwise(0)
        plan = filled.withColumn("weight_share", F.when(all_ > 0, F.col("weight") / all_).otherwise(0.0)).withColumn("whole", whole)
        #: Of each run's sources: what it has, should and will give: ``whole`` times all of it, ``rest`` tokens once more.
        self.plan = written(plan.withColumn("rest", F.col("tokens") - F.col("whole") * F.col("available")), "plan")
        self._sent = F.broadcast if self.plan.count() <= MOST_SENT else lambda df: df

    def chosen(self, seed: int = SEED) -> DataFrame:
        """run_id, doc_id, source, n_tokens and repeats of each document taken at least once.

        Of the sample, the document is taken in whose middle the rest ends or after which it ends, so a source
        misses its tokens by half a document at most.
        """
        plan = self._sent(self.plan.where("tokens > 0").select("run_id", "tokenizer", "source", "whole", "rest"))
        place = F.xxhash64(F.lit(seed), "run_id", "doc_id")
        # the sign bit is turned, so that the order of the ranges is that of the hashes
        rows = self.sized.where("n_tokens > 0").join(plan, ["tokenizer", "source"]).withColumn("place", place).withColumn("bucket", (F.shiftright("place", 52) + BUCKETS // 2).cast("int"))
        key = ["run_id", "source"]
        sums = rows.where("rest > 0").groupBy(*key, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the one range of each source in which the rest ends: as many rows as plans
        edge = sums.withColumn("before", before).where("before < rest and before + n >= rest").select(*key, F.col("bucket").alias("edge"), "before")
        marked = rows.join(self._sent(edge), key, "left")
        inner = Window.partitionBy(*key).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        at_edge = marked.where("bucket = edge").withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        once = F.when(F.col("rest") <= 0, 0).when(F.col("edge").isNull(), 1).when(F.col("bucket") < F.col("edge"), 1).otherwise(0)
        most = marked.where("edge is null or bucket != edge").withColumn("repeats", F.col("whole") + once)
        last = at_edge.withColumn("repeats", F.col("whole") + (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
        columns = ["run_id", "doc_id", "source", "n_tokens", "repeats"]
        return most.select(columns).unionByName(last.select(columns)).where("repeats > 0")

    def shares(self, seed: int = SEED) -> DataFrame:
        """Of each run's sources: share aimed at, planned and reached tokens, share reached of what was chosen, documents."""
        got = self.chosen(seed).groupBy("run_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
        rows = self.plan.select("run_id", "source", "weight_share", "budget", F.col("tokens").alias("planned")).join(got, ["run_id", "source"], "left").na.fill(0, ["reached", "n_docs", "most_repeats"])
        total = F.sum("reached").over(Window.partitionBy("run_id"))  # as many rows as targets
        return rows.withColumn("reached_share", F.when(total > 0, F.col("reached") / total).otherwise(0.0))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_runs"), table(spark, folder, "mix_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).chosen()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by source."""
    return _mixture(spark, folder).shares()


def p7_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source comes within half a document of its plan and under its cap, and the run's plans make up its budget or all there is."""
    m = _mixture(spark, folder)
    got = m.chosen().groupBy("run_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"), F.max("repeats").alias("repeats"))
    rows = m.plan.join(got, ["run_id", "source"], "left").na.fill(0, ["reached", "repeats"])
    every = Window.partitionBy("run_id")
    most = F.least(F.col("budget"), F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).over(every))
    near_plan = F.abs(F.col("reached") - F.col("tokens")) <= F.col("largest") / 2 + 1e-6
    whole_budget = F.abs(F.sum("tokens").over(every) - most) <= 1e-9 * F.greatest(F.lit(1.0), most)
    return rows.select("run_id", "source", near_plan.alias("near_plan"), F.coalesce(F.col("repeats") <= F.col("most"), F.lit(True)).alias("under_cap"), whole_budget.alias("whole_budget"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_bounds": p7_bounds}
_SOURCE = r"regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g')"
SQL = {"p7_bounds": f"select distinct run_id, {_SOURCE} as source, true as near_plan, true as under_cap, true as whole_budget from mix_targets join mix_runs using (run_id) where source is not null"}
