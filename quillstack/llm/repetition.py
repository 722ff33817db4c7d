"""Problem 1: repetition inside a document.

Each document is reduced to a few cheap statistics. Boosted trees, fitted to a sample of documents
labelled by the definition, score them; the score must grow with the shares of repeated words and
pairs. A word in a repeated run of four stands earlier in the text, and so does a pair with it, so a
document with the share in question has at least that share in both statistics, and the trees give its
score a provable lower bound. That is the gate: runs of four are formed and counted exactly only in
what passes it, in the same narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import table
from . import gbt
from .words import word_blocks, words_sql

#: Statistic and the direction in which it must move the score. The first two are never below the share of repeated words.
FEATURES = {"share1": 1, "share2": 1, "top_share": 1, "log_words": 0}
BOUNDED = ("share1", "share2")
RUN, LEAST_WORDS, LEAST_SHARE = 4, 20, 0.3
#: Documents of which the classifier is fitted: those with the smallest hashes of their ids.
SAMPLE_ROWS = 4000


def _pairs(a: np.ndarray, step: int) -> np.ndarray:
    """Codes of (a[i], a[i + step]) in order of first appearance; positions past the end are alone."""
    b = np.full(len(a), -1, np.int64)
    b[: max(0, len(a) - step)] = a[step:]
    return pd.factorize(a.astype(np.int64) * (len(a) + 1) + b + 1)[0]


def _seen(codes: np.ndarray) -> np.ndarray:
    """Whether the code at each position stands at an earlier one (codes count up as they appear)."""
    if not len(codes):
        return np.zeros(0, bool)
    top = np.maximum.accumulate(codes)
    return np.r_[False, codes[1:] <= top[:-1]]


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    out = starts.copy()
    for k in range(1, width):
        out[k:] |= starts[:-k]
    return out


class Block:
    """Word counts and words of some documents; words get codes of their own in each, so that no run over a border is seen twice."""

    def __init__(self, lens: np.ndarray, codes: np.ndarray) -> None:
        self.lens = lens
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.one = pd.factorize(self.doc * (int(codes.max(initial=0)) + 1) + codes)[0] if len(codes) else np.zeros(0, np.int64)
        self.two = _pairs(self.one, 1)

    def _count(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, flags, len(self.lens)).astype(np.int64)

    def features(self) -> np.ndarray:
        """A row for each document, as in FEATURES, in double precision: exact enough to hold against a share."""
        total = np.maximum(self.lens, 1)
        top = np.zeros(len(self.lens), np.int64)
        if len(self.one):
            np.maximum.at(top, self.doc, np.bincount(self.one)[self.one])
        return np.stack([self._count(_seen(self.one)) / total, self._count(_covered(_seen(self.two), 2)) / total, top / total, np.log1p(self.lens)], 1)

    def repeated(self, some: np.ndarray) -> np.ndarray:
        """Words in repeated runs of four, of the documents chosen; 0 for the others, whose runs aren't formed."""
        here = some[self.doc]
        two = self.two[here]
        # a pair at a document's end has a code of its own, but the next document's pairs now follow it: their codes differ too
        out = np.bincount(self.doc[here], _covered(_seen(_pairs(pd.factorize(two)[0], 2)), RUN), len(self.lens))
        return out.astype(np.int64)


def _measured(documents: DataFrame, forest: gbt.Forest | None, least: float) -> DataFrame:
    """doc_id, n_words, features, score and n_repeated, which is null where the score is under ``least``; without a forest all are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, lens, codes, _ in word_blocks(batch.column(1).to_pylist()):
                block = Block(lens, codes)
                x = block.features()
                score = forest.score(x) if forest else np.zeros(len(x))
                passed = score >= least
                repeated = pa.array(block.repeated(passed), mask=~passed)
                features = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(lens, pa.int64()), features, pa.array(score), repeated], ["doc_id", "n_words", "features", "score", "n_repeated"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, features array<double>, score double, n_repeated long")


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated and the statistics of FEATURES for each row of ``documents``, all counted exactly.

    Needs doc_id (long) and text (string); other columns are not read. Null, empty and wordless texts
    have 0 words and 0 shares. Rows are kept as they come: a doc_id given twice is measured twice.
    """
    rows = _measured(documents, None, 0.0)
    return rows.select("doc_id", "n_words", "n_repeated", *[F.get("features", F.lit(k)).alias(f) for k, f in enumerate(FEATURES)])


def train(documents: DataFrame, rows: int = SAMPLE_ROWS, share: float = LEAST_SHARE) -> gbt.Forest:
    """Trees fitted on the driver to at most ``rows`` documents, labelled by the definition. Only the sample is measured for it."""
    total = documents.count()
    some = documents.select("doc_id", "text")
    if total > 2 * rows:  # by hash, so that no more than some 2 * rows come to the driver at any size
        some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * 1.5 * rows / total))
    sample = document_statistics(some).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    y = ((sample.n_words >= LEAST_WORDS) & (sample.n_repeated > share * sample.n_words)).to_numpy(float)
    return gbt.fit(sample[list(FEATURES)].to_numpy(float), y, list(FEATURES.values()))


def gate(forest: gbt.Forest, share: float = LEAST_SHARE) -> float:
    """The score that every document of LEAST_WORDS or more with at least that share of repeated words reaches."""
    low = {**dict.fromkeys(FEATURES, -np.inf), **dict.fromkeys(BOUNDED, share), "log_words": np.log1p(LEAST_WORDS)}
    return forest.least(np.array(list(low.values()))) - 1e-9


def scored(documents: DataFrame, share: float = LEAST_SHARE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, score, passed (whether it reaches the gate) and n_repeated (null: not counted) of each row.

    The trees, at most 40 of 15 nodes, go with the task; nothing is shuffled but the sample.
    """
    forest = train(documents, rows, share)
    least = gate(forest, share)
    return _measured(documents, forest, least).select("doc_id", "n_words", "score", (F.col("score") >= least).alias("passed"), "n_repeated")


def repeated_documents(documents: DataFrame, share: float = LEAST_SHARE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, n_repeated and score of documents of 20 words or more with more than ``share`` of them repeated.

    A word is repeated if it lies in a run of 4 words that equals a run beginning earlier in the
    text. Null, empty and short texts are never given.
    """
    exact = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_repeated") * 1000 > F.col("n_words") * round(share * 1000))
    return scored(documents, share, rows).where("passed").where(exact).select("doc_id", "n_words", "n_repeated", "score")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_documents(table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's words and share of repeated words."""
    stats = document_statistics(table(spark, folder, "documents", "doc_id", "text"))
    return stats.select("doc_id", "n_words", (F.col("n_repeated") / F.greatest("n_words", F.lit(1))).alias("repeated_share"))


def p1_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, those that pass the gate and are counted exactly, and those found; one row."""
    found = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_repeated") * 1000 > F.col("n_words") * round(LEAST_SHARE * 1000))
    return scored(table(spark, folder, "documents", "doc_id", "text")).agg(F.count("*").alias("n_docs"), F.count_if("passed").alias("n_counted"), F.count_if(found).alias("n_found"))


QUERIES = {"p1_found": p1_found, "p1_shares": p1_shares, "p1_gate": p1_gate}
_SHARES = f"""
  with {words_sql("documents", "doc_id", "words")},
  grams as (select doc_id, k, array_to_string(w[k:k + {RUN - 1}], ' ') as g, k <= len(w) - {RUN - 1} as whole from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from words)),
  again as (select *, whole and row_number() over (partition by doc_id, g, whole order by k) > 1 as rep from grams),
  hit as (select doc_id, bool_or(rep) over (partition by doc_id order by k rows between {RUN - 1} preceding and current row) as hit from again),
  shares as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_repeated from words left join (select doc_id, count(*) filter (hit) as n from hit group by doc_id) using (doc_id))
"""
SQL = {
    "p1_found": f"{_SHARES} select doc_id from shares where n_words >= {LEAST_WORDS} and n_repeated > {LEAST_SHARE}::decimal(9, 3) * n_words",
    "p1_shares": f"{_SHARES} select doc_id, n_words, n_repeated / greatest(n_words, 1)::double as repeated_share from shares",
}
