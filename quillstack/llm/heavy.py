"""Problem 2: the most frequent items, in memory that does not grow with the distinct ones.

Each partition keeps a space-saving summary of weighted counts. Summaries are merged in a tree, a
bounded number at each node. A summary's bound covers every item it does not hold, so all items over
the threshold survive; a second pass counts the survivors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import table, written

#: White space of Unicode, as a class of both Java's and DuckDB's regular expressions. Fixed values.
BLANKS = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FAN_IN = 16
_SUMMARY = "node long, item string, high long, error long, bound long, weight long"


def plain_form(form: Column) -> Column:
    """Lower case, trimmed, each blank run one space."""
    return F.lower(F.trim(F.regexp_replace(form, BLANKS + "+", " ")))


class Summary:
    """Space-saving counters. ``high`` is never below an item's true weight, ``high - error`` never
    above it, and no item outside weighs more than ``bound``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bound, self.weight = capacity, 0, 0
        self.rows = pd.DataFrame({"high": pd.Series(dtype="int64"), "error": pd.Series(dtype="int64")})

    def add(self, other: pd.DataFrame, bound: int, weight: int) -> None:
        """Merges counters (index item, columns high and error) whose outsiders weigh at most ``bound``."""
        both = self.rows.join(other, how="outer", rsuffix="_2")
        mine, theirs = both.high.isna(), both.high_2.isna()
        high = both.high.fillna(self.bound) + both.high_2.fillna(bound)
        error = both.error.where(~mine, self.bound) + both.error_2.where(~theirs, bound)
        rows = pd.DataFrame({"high": high, "error": error}).astype("int64")
        self.bound += bound
        self.weight += weight
        if len(rows) > self.capacity:
            rows = rows.reset_index(names="item").sort_values(["high", "item"], ascending=[False, True]).set_index("item")
            self.bound = max(self.bound, int(rows.high.iloc[self.capacity]))
            rows = rows.iloc[: self.capacity]
        self.rows = rows

    def frame(self, node: int) -> pd.DataFrame:
        """One row a counter; an empty summary has one row without item, which carries the weight."""
        rows = self.rows.reset_index(names="item")
        if rows.empty:
            rows = pd.DataFrame({"item": [None], "high": [0], "error": [0]})
        return rows.assign(node=node, bound=self.bound, weight=self.weight)[["node", "item", "high", "error", "bound", "weight"]]


def _summarise(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            if batch.num_rows:
                got = pa.Table.from_batches([batch]).group_by("item").aggregate([("weight", "sum")]).to_pandas().set_index("item")
                summary.add(pd.DataFrame({"high": got.weight_sum, "error": 0}), 0, int(got.weight_sum.sum()))
        out = summary.frame(TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("node", pa.int64()), ("item", pa.string()), ("high", pa.int64()), ("error", pa.int64()), ("bound", pa.int64()), ("weight", pa.int64())]), preserve_index=False)

    return run


def _merge(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        summary = Summary(capacity)
        for _, part in rows.groupby("node"):
            own = part.dropna(subset=["item"]).set_index("item")[["high", "error"]]
            summary.add(own, int(part.bound.iloc[0]), int(part.weight.iloc[0]))
        return summary.frame(int(key[0]))

    return run


def summary_of(weighted: DataFrame, capacity: int) -> DataFrame:
    """One merged summary of ``weighted`` (item string, weight long > 0): at most ``capacity`` rows.

    Every node of the tree reads at most FAN_IN summaries.
    """
    parts = weighted.rdd.getNumPartitions()
    out = weighted.select("item", "weight").mapInArrow(_summarise(capacity), _SUMMARY)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        # the group's key names the parent; the node of each row still tells the summaries apart
        out = out.groupBy(F.floor(F.col("node") / FAN_IN).alias("parent")).applyInPandas(_merge(capacity), _SUMMARY)
    return out


def frequent_items(weighted: DataFrame, share_of: int = 200, capacity: int = 2000, most: int = 1 << 20) -> DataFrame:
    """item, low, high (bounds of the first pass) and total (exact) of items with at least 1/share_of of all weight.

    ``weighted`` has item (string) and weight (long); null items and weights that are null or not
    positive don't count; no rows give no rows. It is read twice, so it should be a table. If the
    bound on what the summary left out reaches the threshold, the pass is repeated with twice the
    capacity: an item over the threshold is never lost. A share so small that it would take more than
    ``most`` counters is counted exactly by a shuffle of all items, pre-aggregated; low and high are then the total.
    """
    fine = weighted.where("item is not null and weight > 0")
    while capacity <= most:
        rows = summary_of(fine, capacity).toPandas()  # at most `capacity` rows
        weight, bound = (int(rows.weight.max()), int(rows.bound.max())) if len(rows) else (0, 0)
        if bound * share_of < weight or weight == 0:
            break
        capacity *= 2
    else:
        weight = fine.agg(F.sum("weight")).first()[0] or 0
        totals = fine.groupBy("item").agg(F.sum("weight").alias("total"))
        return totals.where(F.col("total") * share_of >= F.lit(weight)).select("item", F.col("total").alias("low"), F.col("total").alias("high"), "total")
    keep = rows.dropna(subset=["item"])
    keep = keep[keep.high * share_of >= weight]
    spark = weighted.sparkSession
    few = spark.createDataFrame([(r.item, int(r.high - r.error), int(r.high)) for r in keep.itertuples()], "item string, low long, high long")
    exact = fine.join(F.broadcast(few), "item").groupBy("item", "low", "high").agg(F.sum("weight").alias("total"))
    return exact.where(F.col("total") * share_of >= F.lit(weight))


def once_by_id(rows: DataFrame, item: str, weight: str) -> DataFrame:
    """item and weight of each id once, by its latest row; rows without id are left out: nothing could tell that one is delivered again."""
    fine = rows.where(F.col("id").isNotNull() & F.col(item).isNotNull() & (F.col(weight) > 0))
    return fine.groupBy("id").agg(F.max(F.struct("created_at", F.col(weight).cast("long").alias("weight"), F.col(item).alias("item"))).alias("r")).select("r.item", "r.weight")


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    phrases = table(spark, folder, "phrase_library", "id", "canonical_form", "frequency", "created_at")
    plain = phrases.select("id", plain_form(F.col("canonical_form")).alias("form"), "frequency", "created_at")
    return written(once_by_id(plain.where("form != ''"), "form", "frequency"), "forms")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_items(_forms(spark, folder)).select(F.col("item").alias("canonical_form"))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The frequent forms with their exact totals."""
    return frequent_items(_forms(spark, folder)).select(F.col("item").alias("canonical_form"), "total")


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The frequent forms with their exact totals, and whether the bounds of the first pass hold."""
    return frequent_items(_forms(spark, folder)).select(F.col("item").alias("canonical_form"), "total", (F.col("low") <= F.col("total")).alias("over_low"), (F.col("high") >= F.col("total")).alias("under_high"))


_FORMS = rf"""
  with plain as (
    select id, lower(trim(regexp_replace(canonical_form, '{BLANKS}+', ' ', 'g'))) as form, frequency, created_at
    from phrase_library),
  once as (
    select form, frequency from plain where id is not null and form <> '' and frequency > 0
    qualify row_number() over (partition by id order by created_at desc nulls last, frequency desc, form desc) = 1),
  totals as (select form as canonical_form, cast(sum(frequency) as bigint) as total from once group by form)
"""
_OVER = "where total * 200 >= (select sum(total) from totals)"
QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p2_bounds": p2_bounds}
SQL = {"p2_found": f"{_FORMS} select canonical_form from totals {_OVER}", "p2_totals": f"{_FORMS} select canonical_form, total from totals {_OVER}", "p2_bounds": f"{_FORMS} select canonical_form, total, true as over_low, true as under_high from totals {_OVER}"}
