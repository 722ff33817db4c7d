"""Problem 3: how often every term occurs, kept up to date by signed deltas.

A store holds two tables cut into buckets by hash: the latest state of each record, and each term's
occurrences and records. A change set is merged with the records it names; what was there counts
negative, what is there now counts positive, and the sums of these deltas by term are merged into the
touched buckets alone. Buckets are never changed in place: a new version is written beside the old, and
a manifest, moved into place as the last step, names the folder of each bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import file_system, new_path, removed, table
from .heavy import BLANKS

#: White space at either end.
_EDGES = f"^{BLANKS}+|{BLANKS}+$"
_COUNTS = "term string, occurrences long, records long"
#: Records of a bucket, on average at most; with more the number of buckets doubles.
BUCKET_ROWS = 1 << 22
#: Buckets up to which each task writes its rows of every bucket; with more, rows are first brought together by bucket.
_FEW = 64


class TermStore:
    """Counts of terms in the folder ``path``; opened again, it goes on from its last complete version."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def manifest(self) -> dict:
        """The last version: its number, buckets, records (an upper bound), type of order, and each table's folder by bucket."""
        fs, at = file_system(self.spark, f"{self.path}/manifest")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": 1, "rows": 0, "order": None, "records": {}, "counts": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])

    def _put(self, manifest: dict) -> None:
        name = f"{self.path}/manifest/{manifest['version']:012d}.json"
        fs, at = file_system(self.spark, name)
        if fs.exists(at):
            raise ValueError(f"version {manifest['version']} exists: another writer was faster")
        part = file_system(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")[1]
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, at):
            raise ValueError(f"version {manifest['version']} couldn't be put in place")

    def _bucket(self, key: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        schema = _COUNTS if name == "counts" else f"id string, order {manifest['order']}, term string, weight long"
        paths = sorted(p for b, p in manifest[name].items() if buckets is None or int(b) in buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, manifest: dict, name: str, folder: str, rows: DataFrame, key: str, touched: set[int] | None) -> None:
        """Writes a table's touched buckets (None: all) and puts their folders into the manifest."""
        rows = rows.withColumn("bucket", self._bucket(key, manifest["buckets"]))
        rows = rows.repartition("bucket") if manifest["buckets"] > _FEW else rows
        rows.write.partitionBy("bucket").parquet(f"{folder}/{name}")
        fs, at = file_system(self.spark, f"{folder}/{name}")
        there = {n.removeprefix("bucket="): f"{folder}/{name}/{n}" for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.startswith("bucket=")}
        kept = {} if touched is None else {b: p for b, p in manifest[name].items() if int(b) not in touched}
        manifest[name] = kept | there

    def counts(self) -> DataFrame:
        """term, occurrences and records of every term that has a record."""
        return self._read(self.manifest(), "counts")

    def apply(self, changes: DataFrame) -> None:
        """Merges ``changes``: id, term (null: the record is deleted), weight, and order.

        A record's state is that of its change with the greatest order (null is least), of equal ones with the
        greatest term and weight, whenever it comes: what comes late with an older order moves nothing, a deleted
        record stays deleted for older changes. A null weight is 0. Rows without id are left out: nothing could tell
        that one is delivered again.
        """
        last = self.manifest()
        folder = f"{self.path}/v{last['version'] + 1}-{uuid.uuid4().hex}"
        state = F.struct("order", "term", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
        changes.where("id is not null").groupBy("id").agg(F.max(state).alias("s")).select("id", "s.*").write.parquet(f"{folder}/changes")
        new = self.spark.read.parquet(f"{folder}/changes")
        rows = last["rows"] + new.count()
        now = last | {"version": last["version"] + 1, "order": last["order"] or new.schema["order"].dataType.simpleString()}
        while rows > now["buckets"] * self.bucket_rows:
            now["buckets"] *= 2
        whole = now["buckets"] != last["buckets"] or now["buckets"] == 1
        of = lambda df, key: {r.b for r in df.select(self._bucket(key, now["buckets"]).alias("b")).distinct().collect()}  # noqa: E731  at most `buckets` rows
        touched = None if whole else of(new, "id")
        was = F.struct("order", "term", "weight")
        old = self._read(now, "records", touched).select("id", was.alias("s"), was.alias("was"))
        both = old.unionByName(new.select("id", was.alias("s")), allowMissingColumns=True).groupBy("id").agg(F.max("s").alias("s"), F.max("was").alias("was"))
        moved = ~(F.col("s.term").eqNullSafe(F.col("was.term")) & F.col("s.weight").eqNullSafe(F.col("was.weight")))
        self._write(now, "records", folder, both.select("id", "s.*", F.col("was.term").alias("was_term"), F.col("was.weight").alias("was_weight"), moved.alias("moved")), "id", touched)
        # only records that are added, changed or deleted give deltas; they stand with the records just written
        at = [p for p in now["records"].values() if p.startswith(folder)]
        states = self.spark.read.schema("term string, weight long, was_term string, was_weight long, moved boolean").parquet(*at).where("moved") if at else None
        if states is not None:
            plus, minus = F.struct(F.col("term").alias("term"), F.col("weight").alias("n"), F.lit(1).alias("r")), F.struct(F.col("was_term").alias("term"), (-F.col("was_weight")).alias("n"), F.lit(-1).alias("r"))
            deltas = states.select(F.explode(F.array(plus, minus)).alias("d")).where("d.term is not null").select("d.term", F.col("d.n").alias("occurrences"), F.col("d.r").cast("long").alias("records"))
            hit = None if whole else of(deltas, "term")
            merged = self._read(now, "counts", hit).unionByName(deltas).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")
            self._write(now, "counts", folder, merged, "term", hit)
        now["rows"] = self._read(now, "records").count() if whole else rows
        self._put(now)
        removed(self.spark, f"{folder}/changes")

    def vacuum(self) -> None:
        """Removes what the last version doesn't name; no reader or writer may be at work."""
        last = self.manifest()
        named = {p.removeprefix(f"{self.path}/").split("/")[0] for t in ("records", "counts") for p in last[t].values()}
        fs, at = file_system(self.spark, self.path)
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName() not in {"manifest", *named}:
                fs.delete(x.getPath(), True)
        at = file_system(self.spark, f"{self.path}/manifest")[1]
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName() != f"{last['version']:012d}.json":
                fs.delete(x.getPath(), True)


def marked(counts: DataFrame, tokens: int, rare: int = 5, common_of: int = 1000) -> DataFrame:
    """term, occurrences, records and mark of the terms too rare or too common; a term that is both has two rows.

    ``rare``: fewer occurrences than that, or a single record. ``common``: at least 1/common_of of ``tokens``.
    """
    marks = F.array(F.when((F.col("occurrences") < rare) | (F.col("records") == 1), "rare"), F.when(F.col("occurrences") * common_of >= F.lit(tokens), "common"))
    return counts.withColumn("mark", F.explode(F.array_compact(marks)))


def corpus_tokens(stats: DataFrame) -> int:
    """The sum of token_count, each video_id once by its latest processed_at, null as 0; 0 for no rows.

    Rows without video_id count each. Of rows as late as another, the one with more tokens counts.
    """
    n = F.coalesce("token_count", F.lit(0)).cast("long").alias("n")
    named = stats.where("video_id is not null").groupBy("video_id").agg(F.max(F.struct("processed_at", n)).alias("r")).select("r.n")
    total = named.unionByName(stats.where("video_id is null").select(n)).agg(F.sum("n")).first()
    return int(total[0] or 0)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "word_library", "id", "surface", "frequency", "created_at")
    plain = words.select("id", F.lower(F.regexp_replace("surface", _EDGES, "")).alias("term"), F.col("frequency").alias("weight"), F.col("created_at").alias("order")).where("term != ''")
    store = TermStore(spark, new_path(spark, "terms"))
    # the table comes as two loads, as it would day by day: what the second delivers again moves nothing
    span = plain.agg(F.min("order").cast("double"), F.max("order").cast("double")).first()
    half = F.timestamp_seconds(F.lit(((span[0] or 0) + (span[1] or 0)) / 2))
    store.apply(plain.where(F.col("order") < half))
    store.apply(plain.where((F.col("order") >= half) | F.col("order").isNull()))
    return store.counts()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tokens = corpus_tokens(table(spark, folder, "corpus_stats", "video_id", "token_count", "processed_at"))
    return marked(_counts(spark, folder), tokens).select(F.col("term").alias("surface"), "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each surface's occurrences and records."""
    return _counts(spark, folder).select(F.col("term").alias("surface"), "occurrences", "records")


_TERMS = f"""
  with plain as (select id, lower(regexp_replace(surface, '{_EDGES}', '', 'g')) as surface, coalesce(frequency, 0) as n, created_at from word_library),
  once as (
    select surface, n from plain where id is not null and surface <> ''
    qualify row_number() over (partition by id order by created_at desc nulls last, surface desc, n desc) = 1),
  counts as (select surface, cast(sum(n) as bigint) as occurrences, count(*) as records from once group by surface),
  videos as (
    select coalesce(token_count, 0) as n from corpus_stats
    qualify row_number() over (partition by video_id order by processed_at desc nulls last, coalesce(token_count, 0) desc) = 1),
  corpus as (select sum(n) as tokens from videos)
"""
QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p3_found": f"{_TERMS} select surface, 'rare' as mark from counts where occurrences < 5 or records = 1 union all select surface, 'common' from counts, corpus where occurrences * 1000 >= tokens",
    "p3_counts": f"{_TERMS} select surface, occurrences, records from counts",
}
