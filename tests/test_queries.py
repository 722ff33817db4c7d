from pathlib import Path

import pytest

from quillstack import constants as C
from quillstack import queries
from quillstack.functions import text as T

from .oracle import FOLDER, compare, connection

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, con, name):
    compare(con, queries.QUERIES[name](spark, FOLDER), queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_flagship(spark):
    rows = queries.flagship(spark, FOLDER).collect()
    assert rows and all(r.n_tokens == r.tier0 + r.tier1 + r.tier2 + r.tier3 + r.oov for r in rows)


def test_every_length_by_hand(spark, con):
    grams = {n: {} for n in range(2, 10)}
    for (text,) in spark.read.parquet(f"{FOLDER}/documents.parquet").select(T.words("text")).collect():
        for n in grams:
            for k in range(len(text or []) - n + 1):
                key = " ".join(text[k : k + n])
                grams[n][key] = grams[n].get(key, 0) + 1
    want = {(n, len(g), sum(g.values())) for n, g in grams.items()}
    assert {(r.n, r.n_phrases, r.n_occurrences) for r in queries.ngrams_by_length(spark, FOLDER).collect()} == want


def test_codec_totals_goes_over_documents_once(spark, monkeypatch):
    entries = spark.createDataFrame(list(C.TIER0_IDS.items()), "surface string, base64_id string")
    monkeypatch.setattr(queries, "_v03", lambda s, d: (entries, None))
    got = queries.codec_totals(spark, FOLDER)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.first().all_same
