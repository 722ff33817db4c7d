import html
import random
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import bpe, gbt, heavy, leaks, mixture, registry, repetition, residue, spans, termcounts, words
from quillstack.llm.windows import Hashed, chosen

from ..oracle import FOLDER, compare, connection
from .wordings import HELD_BACK, REAL

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def docs(spark, rows):
    """Documents with a column of a clashing name beside doc_id and text."""
    return spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, score int")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    compare(connection(), registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name])


def plain_words(text):
    lines = [x for x in html.unescape(text or "").split("\n") if not (x.strip() and all(c in "0123456789" for c in x.strip())) and "-->" not in x]
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in "\n".join(lines).lower()).split(" ") if text else []


@settings(deadline=None)
@given(st.text(st.sampled_from("aB1é²_ \t\n\r>-&;lt'你"), max_size=60))
def test_words(text):
    assert words.words_of(text) == [w for w in plain_words(text) if w]


# --- 1


def share(text):
    w, seen, hit = [x for x in plain_words(text) if x], set(), set()
    for k in range(len(w) - 3):
        g = tuple(w[k : k + 4])
        hit |= {k, k + 1, k + 2, k + 3} if g in seen else set()
        seen.add(g)
    return len(w), len(hit)


def test_repetition(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choice("abcdefgh"[: random.choice([3, 8])] + "ijklmnopqrstuvwxyz" * random.choice([0, 1])) for _ in range(random.randrange(120)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\n"), (1003, "a " * 19), (1004, "a " * 20), (1005, "x y " * 60_000), (1006, "1\n2\n3\n" * 30)]
    got = {r.doc_id: r for r in repetition.document_statistics(docs(spark, rows)).collect()}
    for k, t in rows:
        assert (got[k].n_words, got[k].n_repeated) == share(t)
    found = {r.doc_id for r in repetition.repeated_documents(docs(spark, rows)).collect()}
    assert found == {k for k, t in rows if share(t)[0] >= 20 and share(t)[1] > 0.3 * share(t)[0]} and 1005 in found
    assert repetition.repeated_documents(docs(spark, rows).limit(0)).count() == 0


def test_repetition_on_the_table(spark):
    want = {r.doc_id for r in table(spark, "documents").collect() if share(r.text)[0] >= 20 and share(r.text)[1] > 0.3 * share(r.text)[0]}
    assert {r.doc_id for r in repetition.p1_found(spark, FOLDER).collect()} == want


def test_exact_counts_only_behind_the_gate(spark):
    want = {r.doc_id for r in repetition.document_statistics(table(spark, "documents")).where("n_words >= 20 and n_repeated * 10 > n_words * 3").collect()}
    rows = repetition.scored(table(spark, "documents"), rows=80).collect()
    counted = {r.doc_id for r in rows if r.n_repeated is not None}
    assert counted == {r.doc_id for r in rows if r.passed} and want <= counted and len(counted) < len(rows)


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "a b c d", "a b c d e f g"])
def test_repetition_of_few_words(spark, text):
    got = repetition.document_statistics(docs(spark, [(1, text)])).collect()
    assert [(r.doc_id, r.n_words, r.n_repeated) for r in got] == [(1, len(text.split()), 0)]


def test_trees_are_monotone_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) > 0.6) ^ (rng.random(600) < 0.05)).astype(float)
    f = gbt.fit(x, y, [1, 0, -1])
    assert ((f.score(x) > 0) == y).mean() > 0.85
    up, down = x.copy(), x.copy()
    up[:, 0] += rng.random(600)
    down[:, 2] += rng.random(600)
    assert (f.score(up) >= f.score(x) - 1e-9).all() and (f.score(down) <= f.score(x) + 1e-9).all()
    low = np.array([0.5, -np.inf, -np.inf])
    assert f.score(x[x[:, 0] >= 0.5]).min() >= f.least(low) - 1e-9
    assert len(gbt.fit(x[:0], y[:0], [1, 0, 0]).score(x)) == 600
    held = rng.random((400, 3))
    assert ((f.score(held) > 0) == (held[:, 0] + 0.3 * np.sin(20 * held[:, 1]) > 0.6)).mean() > 0.8


# --- 2


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.integers(1, 9)), max_size=60), st.integers(1, 6))
def test_summaries_bound_every_item(rows, capacity):
    import pandas as pd

    parts = []
    for k in range(0, len(rows), 7):
        s = heavy.Summary(capacity)
        for item, n in rows[k : k + 7]:
            s.add(pd.DataFrame({"high": [n], "error": [0]}, index=[item]), 0, n)
        parts.append(s)
    whole = heavy.Summary(capacity)
    for p in parts:
        whole.add(p.rows, p.bound, p.weight)
    true = Counter()
    for item, n in rows:
        true[item] += n
    assert whole.weight == sum(true.values()) and len(whole.rows) <= capacity
    for item, n in true.items():
        if item in whole.rows.index:
            r = whole.rows.loc[item]
            assert r.high - r.error <= n <= r.high
        else:
            assert n <= whole.bound


def test_frequent_items(spark):
    random.seed(5)
    rows = [(f"x{int(random.paretovariate(0.7)) % 3000}", random.randrange(1, 5)) for _ in range(20_000)] + [(None, 9), ("n", None), ("z", 0), ("m", -5)]
    df = spark.createDataFrame(rows, "item string, weight long").repartition(40)
    true = Counter()
    for i, w in rows:
        if i is not None and w and w > 0:
            true[i] += w
    want = {i: n for i, n in true.items() if n * 200 >= sum(true.values())}
    for capacity, most in ((3, 1 << 20), (400, 1 << 20), (3, 6)):
        got = heavy.frequent_items(df, capacity=capacity, most=most).collect()
        assert {r.item: r.total for r in got} == want and all(r.low <= r.total <= r.high for r in got)
    assert heavy.frequent_items(df.limit(0)).count() == 0
    assert heavy.frequent_items(spark.createDataFrame([("a", 1)] * 3, "item string, weight long")).first().total == 3


# --- 3


@pytest.mark.parametrize("bucket_rows", [5, 1 << 22])
def test_term_counts_follow_changes(spark, tmp_path, bucket_rows):
    random.seed(6)
    best = {}
    for step in range(4):
        store = termcounts.TermStore(spark, str(tmp_path), bucket_rows)  # opened anew each time
        rows = [(f"i{random.randrange(40)}", random.choice(["a", "b", "c", None]), random.choice([None, 1, 7]), random.choice([None, *range(9)])) for _ in range(30)] + [(None, "a", 5, 1)]
        for i, t, w, o in rows:
            key = (o is not None, o or 0, t is not None, t or "", w or 0)
            if i is not None and (i not in best or key > best[i][0]):
                best[i] = key, t, w or 0
        store.apply(spark.createDataFrame(rows, "id string, term string, weight int, order int"))
        want = defaultdict(lambda: [0, 0])
        for _, t, w in best.values():
            if t is not None:
                want[t][0] += w
                want[t][1] += 1
        assert {r.term: [r.occurrences, r.records] for r in store.counts().collect()} == dict(want), step
    assert store.manifest()["buckets"] == (1 if bucket_rows > 40 else store.manifest()["buckets"]) and (bucket_rows > 40 or store.manifest()["buckets"] >= 8)
    before = sorted(store.counts().collect())
    store.apply(spark.createDataFrame([], "id string, term string, weight int, order int"))
    store.vacuum()
    assert sorted(termcounts.TermStore(spark, str(tmp_path)).counts().collect()) == before


def test_late_changes_and_deletes_keep_their_order(spark, tmp_path):
    store = termcounts.TermStore(spark, str(tmp_path))
    for rows, want in (
        ([("x", "new", 2, 9)], {"new": (2, 1)}),
        ([("x", "old", 5, 3), ("x", "older", 5, None)], {"new": (2, 1)}),  # late, and undated
        ([("x", None, None, 10), ("y", "a", 1, 1)], {"a": (1, 1)}),
        ([("x", "late", 4, 9)], {"a": (1, 1)}),  # older than the deletion
        ([("x", "again", 4, 11), ("y", "a", 1, 1)], {"a": (1, 1), "again": (4, 1)}),
    ):
        store.apply(spark.createDataFrame(rows, "id string, term string, weight int, order int"))
        assert {r.term: (r.occurrences, r.records) for r in store.counts().collect()} == want


def test_two_writers_of_a_version(spark, tmp_path):
    one, two = termcounts.TermStore(spark, str(tmp_path)), termcounts.TermStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("x", "a", 1, 1)], "id string, term string, weight int, order int")
    stale = two.manifest()
    one.apply(rows)
    two.manifest = lambda: stale
    with pytest.raises(ValueError, match="another writer"):
        two.apply(rows)
    assert [tuple(r) for r in one.counts().collect()] == [("a", 1, 1)]


def test_marks_of_no_rows(spark):
    assert termcounts.corpus_tokens(spark.createDataFrame([], "video_id string, token_count int, processed_at timestamp")) == 0


def test_rows_without_id_are_left_out(spark):
    rows = spark.createDataFrame([("1", "a", 2, 1), ("1", "b", 3, None), (None, "c", 9, 1), ("2", None, 1, 1)], "id string, form string, n int, created_at int")
    assert [tuple(r) for r in heavy.once_by_id(rows, "form", "n").collect()] == [("a", 2)]


# --- 4


def shared(rows, span):
    where, pairs, cover = defaultdict(set), set(), {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            where[t[i : i + span]].add(k)
    for own in where.values():
        pairs |= {(a, b) for a in own for b in own if a < b}
    for k, t in rows:
        hit = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit[i : i + span] = True
        if hit.any():
            cover[k] = int(hit.sum())
    return pairs, cover


def test_shared_spans(spark, monkeypatch):
    random.seed(7)
    letter = lambda n: "".join(random.choice("abcd é😀") for _ in range(n))
    span, pool = 80, [letter(300) for _ in range(6)]
    rows = []
    for k in range(120):
        t = letter(random.randrange(200))
        for _ in range(random.randrange(3)):
            p = random.choice(pool)
            size = random.choice([60, 79, 80, 81, 120, 300])
            at = random.randrange(len(p) - size + 1)
            t += p[at : at + size] + letter(random.randrange(30))
        rows.append((k, t))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "ab" * 300), (505, "ba" * 200), (506, pool[0]), (507, pool[0][:80]), (508, pool[0][220:]), (509, " " * 500), (510, " " * 90)]
    pairs, cover = shared(rows, span)
    got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(docs(spark, rows), span).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 200
    assert {r.doc_id: r.shared_chars for r in spans.shared_lengths(docs(spark, rows), span).collect()} == cover
    texts = dict(rows)
    for r in spans.shared_spans(docs(spark, rows), span).collect():
        part = texts[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length >= span and any(part[:span] in (t or "") for k, t in rows if k != r.doc_id)
    classes = defaultdict(set)
    for r in spans.shared_classes(docs(spark, rows), span).collect():
        classes[r.class_id].add(r.doc_id)
    assert {(a, b) for own in classes.values() for a in own for b in own if a < b} == pairs
    links, copies = spans.shared_links(docs(spark, rows), span)
    rep = dict(tuple(r) for r in copies.select("doc_id", "rep").collect())
    links = {tuple(r) for r in links.collect()}
    own = lambda k: rep.get(k, k)
    assert all(a < b for a, b in links) and links == {tuple(sorted((own(a), own(b)))) for a, b in pairs if own(a) != own(b)}
    monkeypatch.setattr(spans, "GROUP", 7)  # groups in many parts
    again = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(docs(spark, rows), span).collect()]
    assert sorted(again) == sorted(got)
    assert spans.shared_pairs(docs(spark, rows).limit(0), span).count() == 0


def test_one_stretch_in_very_many_documents(spark):
    """A group that all rows are in is cut into even parts; its classes have a row for each member."""
    n, notice = 4000, "".join(random.Random(1).choice("abcdefgh ") for _ in range(120))
    rows = [(k, f"{k}x{notice}{k}") for k in range(n)] + [(n + k, notice * 2) for k in range(3)]
    got = spans.shared_classes(docs(spark, rows), 100)
    assert {r.doc_id for r in got.collect()} == set(range(n + 3)) and got.count() < 8 * n
    keys = spark.createDataFrame([(1, n)], "key int, n long")
    members = spark.createDataFrame([(1, k) for k in range(n)], "key int, doc_id long")
    pairs = spans._paired(members, keys, ["key"], "doc_id")
    assert pairs.count() == n * (n - 1) // 2 and pairs.select(F.least("x", "y"), F.greatest("x", "y")).distinct().count() == n * (n - 1) // 2


def test_shared_spans_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert {(r.doc_id_a, r.doc_id_b) for r in spans.p4_found(spark, FOLDER).collect()} == shared(rows, 400)[0]


@settings(deadline=None)
@given(st.text("ab", min_size=40, max_size=120), st.integers(0, 30))
def test_equal_stretches_choose_equal_windows(text, at):
    codes = np.array([ord(c) for c in text], np.uint32)
    part = codes[at : at + 40]
    if len(part) == 40:
        inner = chosen(Hashed(part).all(10), np.full(40, 40), 10, 40)
        outer = chosen(Hashed(codes).all(10), np.full(len(codes), len(codes)), 10, 40)
        assert {at + k for k in inner.tolist()} <= set(outer.tolist()) and len(inner)


# --- 5


def test_leaks(spark, monkeypatch):
    random.seed(8)
    line = lambda n: " ".join(random.choice(["the", "of", "a", "kitto", "mara", "sol", "and"]) for _ in range(n))
    items = [(k, random.choice(["v1", "v2", None]), line(random.randrange(40))) for k in range(40)] + [(90, "v1", None), (91, "v1", ""), (92, "v9", items_text := line(30)), (93, "v8", items_text)]
    rows = []
    for k in range(300):
        i = random.choice(items)[2] or ""
        w = i.split()
        at = random.randrange(max(1, len(w)))
        rows.append((k, f"{line(random.randrange(30))}, {' '.join(w[at : at + random.choice([8, 11, 12, 13, 40])])}! {line(random.randrange(9))}", random.choice(["v1", "v2", None])))
    rows += [(900, None, "v1"), (901, "", None), (902, "1\n00 --> 1\n" + items_text.upper(), "v9"), (903, items_text.replace(" ", "&nbsp;"), None)]
    grams = defaultdict(set)
    for i, v, t in items:
        w = (t or "").split()
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add((i, v))
    want = set()
    for k, t, v in rows:
        w = [x for x in plain_words(t) if x]
        for j in range(len(w) - 11):
            want |= {(k, i) for i, iv in grams.get(tuple(w[j : j + 12]), ()) if v is None or iv is None or v != iv}
    from quillstack.plans.scratch import new_path

    d = spark.createDataFrame(rows, "doc_id long, text string, video_id string")
    e = spark.createDataFrame([(i, v, t) for i, v, t in items], "item_id long, video_id string, text string")
    path = new_path(spark, "index")
    leaks.build_index(d, path)
    index = spark.read.schema(leaks._INDEX).parquet(path)
    got = [(r.doc_id, r.item_id) for r in leaks.leaked(d, e, leaks.phrase_matches(index, e)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert leaks.phrase_matches(index, e.limit(0)).count() == 0
    whole = sorted(leaks.phrase_matches(index, e).collect())
    one = next(r for r in whole if (r.doc_id, r.item_id) == (902, 92))
    assert (one.leaked_words, one.item_words, one.doc_start) == (30, 30, 0)
    monkeypatch.setattr(leaks, "QUERY_BYTES", 2500)  # many groups of items
    assert sorted(leaks.phrase_matches(index, e).collect()) == whole
    near = {(r.doc_id, r.item_id) for r in leaks.near_matches(index, e, terms=3, reach=5).collect()}
    assert near and all(k not in (900, 901) for k, _ in near)


def near_by_hand(doc, item, terms, reach):
    sets = set()
    for k in range(len(item)):
        own = []
        for w in item[k:]:
            own += [w] * (w not in own)
            if len(own) == terms:
                sets.add(frozenset(own))
                break
    return any(own <= set(doc[max(0, k - reach) : k + reach + 1]) for own in sets for k, w in enumerate(doc) if w in own)


@pytest.mark.parametrize("rows_a_segment", [1, 7, 10_000])
def test_near_is_of_document_and_item_alone(spark, rows_a_segment):
    from quillstack.plans.scratch import new_path

    rng = random.Random(4)
    line = lambda n: [rng.choice("the of a kitto mara sol and in or up by at".split()) for _ in range(n)]
    items = [(k, line(rng.randrange(30))) for k in range(25)] + [(50, [f"x{k}" for k in range(40)])]
    # a passage of item 50, in another order; all its other words stand in another document
    docs = [(k, line(rng.randrange(60))) for k in range(80)] + [(90, line(9) + [f"x{k}" for k in (17, 12, 15, 14, 13, 16)] + line(9)), (91, [f"x{k}" for k in range(40) if not 12 <= k <= 17])]
    want = {(d, i) for d, x in docs for i, y in items if near_by_hand(x, y, 6, 5)}
    assert (90, 50) in want and 100 < len(want) < len(docs) * len(items) // 2
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_segment)
    try:
        path = new_path(spark, "index")
        leaks.build_index(spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id long, text string").coalesce(1), path)
        index = spark.read.schema(leaks._INDEX).parquet(path)
        got = [(r.doc_id, r.item_id) for r in leaks.near_matches(index, spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string"), terms=6, reach=5).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(set(got)) and set(got) == want


@settings(deadline=None)
@given(st.lists(st.integers(0, 1 << 34)))
def test_packed_numbers_come_back(values):
    assert leaks.unpacked(leaks.packed(np.array(values, np.int64))).tolist() == values


# --- 6


@pytest.fixture(scope="module")
def own():
    return bpe.encoder("byte_bpe_50k")


@pytest.fixture(scope="module")
def other(own):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(deadline=None, max_examples=300)
@given(text=st.lists(st.sampled_from(["a", "the", " ", "'", "'re", "'s", "\n", "\t", "!", "12", "é", "你", "\x1c", "😀", "_", "²", "Ⅳ", "<|endoftext|>", "é"]), max_size=40).map("".join), cut=st.integers(1, 9))
def test_ids_are_the_public_ones(own, other, text, cut):
    want = other.encode_ordinary(text)
    assert own.encode(text) == want
    assert list(own.stream((text[i : i + cut] for i in range(0, len(text), cut)), piece=5)) == want
    tokens = [t for t, _ in sorted(own.ranks.items(), key=lambda x: x[1])]
    assert "".join(bpe.decoded(want, tokens)) == text


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000 + "x", "ab" * 30_000, "1" * 9000, "!" * 9000, "the" * 40_000, "é你" * 5000])
def test_long_runs(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)
    assert list(own.stream((text[i : i + 1000] for i in range(0, len(text), 1000)), piece=700)) == other.encode_ordinary(text)


def test_ids_of_tables(spark, other):
    mixed = " ".join(("it's", "x" * 9000, "\n\n", "你" * 3000, "don't", "1" * 5000)[k % 6] for k in range(60))
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (3, "again"), (4, "long words, " * 20_000), (5, "z" * 200_000), (6, mixed), (7, " " * 150_000 + "'ll"), (8, "a" * 65_535 + "'re b")]
    got = sorted((r.doc_id, r.ids) for r in bpe.encoded(docs(spark, rows)).collect())
    assert got == sorted((k, other.encode_ordinary(t or "")) for k, t in rows)
    assert bpe.encoded(docs(spark, rows).limit(0)).count() == 0
    every = table(spark, "documents").select("doc_id", "text").collect()
    assert {r.doc_id: r.ids for r in bpe.p6_ids(spark, FOLDER).collect()} == {r.doc_id: other.encode_ordinary(r.text or "") for r in every}


# --- 7


def by_rounds(weights, caps, budget):
    """Water-filling as it is told: clamp what is over its cap, share the rest out anew."""
    out, open_ = [0.0] * len(weights), {k for k, w in enumerate(weights) if w > 0}
    while open_:
        left = budget - sum(out)
        fill = {k: weights[k] / sum(weights[j] for j in open_) * left for k in open_}
        over = {k for k in open_ if fill[k] >= caps[k]}
        for k in over or open_:
            out[k] = caps[k] if over else fill[k]
        open_ = open_ - over if over else set()
    return out


def test_water_filling(spark):
    rng = random.Random(2)
    runs = [([rng.choice([0, 1, 2, 5 * rng.random()]) for _ in range(n)], [rng.choice([0, 3, float("inf"), 50 * rng.random()]) for _ in range(n)], rng.choice([0, 10, 1e3, 100 * rng.random()])) for n in [1, 2, 3, 5, 9] * 12]
    rows = [(r, k, float(w), float(c), float(b)) for r, (ws, cs, b) in enumerate(runs) for k, (w, c) in enumerate(zip(ws, cs, strict=True))]
    got = {(r.run_id, r.k): r.tokens for r in mixture.water_filled(spark.createDataFrame(rows, "run_id int, k int, weight double, cap double, budget double")).collect()}
    for r, (ws, cs, b) in enumerate(runs):
        assert np.allclose([got[r, k] for k in range(len(ws))], by_rounds(ws, cs, b), rtol=1e-9, atol=1e-9)


def test_mixture(spark):
    random.seed(9)
    rows = [(k, " ".join(["a"] * random.randrange(1, 60)), random.choice(["big"] * 8 + ["Mid-dle", " SMALL", None])) for k in range(3000)] + [(5000, None, "big"), (5001, "", "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = spark.createDataFrame([(1, 0.4, "byte_bpe_50k"), (2, 3.0, "byte_bpe_50k"), (3, 0.0, "byte_bpe_50k")], "run_id int, budget_share double, tokenizer string")
    targets = spark.createDataFrame([(r, s, w, m) for r in (1, 2, 3) for s, w, m in (("big", 1.0, 2), ("mid_dle", 1.0, 3), ("small ", 0.5, 2), ("small", 0.5, None), ("none", 2.0, None), (None, 1.0, 1), ("zero", 0.0, 1))], "run_id int, source string, weight double, max_repeats int")
    m = mixture.Mixture(d, runs, targets)
    got = m.chosen().collect()
    assert len({(r.run_id, r.doc_id) for r in got}) == len(got) and not {r.doc_id for r in got} & {5000, 5001}
    cap = {"big": 2, "mid_dle": 3, "small": 2}
    assert all(r.repeats <= cap[r.source] for r in got)
    for p in m.plan.collect():
        reached = sum(r.n_tokens * r.repeats for r in got if (r.run_id, r.source) == (p.run_id, p.source))
        assert abs(reached - p.tokens) <= 60 if p.available else reached == 0
    assert sorted(got) == sorted(m.chosen().collect())
    assert {(r.run_id, r.source): r.reached for r in m.shares().collect()}[2, "mid_dle"] == sum(r.n_tokens * 3 for r in got if r.run_id == 2 and r.source == "mid_dle")
    assert mixture.Mixture(d.limit(0), runs, targets).chosen().count() == 0
    assert mixture.Mixture(d, runs.limit(0), targets.limit(0)).chosen().count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_tokenizers(spark, name):
    got = bpe.token_counts(docs(spark, [(1, "Hello there"), (2, None), (3, "")]), name)
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [2, 0, 0]


# --- 8

RESIDUE = ["Dear {{ first_name }},", "Hello [INSERT NAME HERE]!", "see ${title} now", "%%TOPIC%% of %(x)s", "Chapter Title: ???", "by (speaker TBD).", "a ________ b", "&lt;video_title&gt; is", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "x\n\nYour text goes here.", "Contenu à venir.", "Hier steht Ihr Text. Inhalt folgt in Kürze.", "Escriba aquí su texto.", "404 Not Found", "<html><head><title>Error 500</title>", '{"error": {"code": 403, "message": "No."}}', "Traceback (most recent call last):\n  File", "ACCESS DENIED.", "Zugriff verweigert.", "Please enable JavaScript to go on.", "<noscript>Activez JavaScript pour voir.</noscript>", "We&#39;re sorry but this app doesn't work properly without scripts."]
FINE = [None, "", "  ", "The template has `{{ name }}` in it", "```\n{{ name }}\nAccess denied.\n```", 'It said "Access denied." and left', "Sie las „Zugriff verweigert.“ laut", "On lut « Contenu à venir. » ici", "Leímos «Escriba aquí su texto.»", "something went wrong with the oven", "Why lorem ipsum says nothing", "10:02:11 ERROR GET /x 404 12ms", "[Music] and [Applause]", "<|im_start|> [PAD] </s>", "People ask why a page not found message is short", "we had to enable JavaScript in it", "# A heading\n\n- [x] task [link](http://x.y)", "todo el mundo", "price $5 and $6", "{\"a\": {\"b\": 1}}", "_________\nrule"]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert residue.residue_of(text) and residue.residue_of(f"Some real words first.\n\n{text}\n\nAnd after.")


@pytest.mark.parametrize("text", FINE)
def test_no_residue(text):
    assert residue.residue_of(text) == []


@pytest.mark.parametrize("text", ["```\nlog line\n\nDear {{ name }},", "~~~ x\nlog\n# Head\nDear {{ name }},", "a ``` in the line\nDear {{ name }},", "```\nlog\n\n{\"error\": {\"code\": 5}}", "```\nlog\n\nText\n\n```py\nx\n```\nDear {{ name }},"])
def test_residue_after_an_unclosed_fence(text):
    assert residue.residue_of(text)


@pytest.mark.parametrize("text", ["```\n{{ a }}\n\nmore", "```py\n{{ a }}\n\n{{ b }}\n```", "   ~~~\n  {{ a }}\n   ~~~\nend", "```a {{ x }}``` and on", "````\n{{ a }}\n````", "```\n{\"error\": {\"code\": 5}}\n\n```"])
def test_no_residue_in_fences(text):
    assert residue.residue_of(text) == []


@pytest.mark.parametrize("kind", HELD_BACK)
def test_wordings_held_back(kind):
    hit = [x for x in HELD_BACK[kind] if any(f[2] == kind for f in residue.residue_of(f"Real words before this.\n\n{x}\n\nAnd after."))]
    assert len(hit) >= 0.9 * len(HELD_BACK[kind])


@pytest.mark.parametrize("text", REAL)
def test_sentences_that_sound_like_it(text):
    assert residue.residue_of(text) == []


LONG = ["{{ user.profile.first_name | default(\"a friend of the show\") | title }}", "[insert " + "a very long hint of what belongs here " * 9 + "]", "<% " + "x.y " * 90 + "%>", "${" + "a." * 200 + "b}", "(the speaker of " + "the evening " * 20 + "TBD)"]


@pytest.mark.parametrize("text", LONG)
def test_residue_of_any_length(text):
    assert [f[2] for f in residue.residue_of(f"Dear {text}, hello")] == ["placeholder"]
    quoted = "word " * 200 + text.replace('"', "'") + " word" * 200
    assert all(residue.residue_of(f"He wrote {a}{quoted}{b} to us") == [] for a, b in ('""', "“”", "«»", "„“", "``"))


def test_coverage_is_of_the_text_as_decoded(spark):
    got = residue.residue(docs(spark, [(1, "&nbsp;&nbsp;&nbsp;\n\n\nAccess denied")])).first()
    assert got.covered == 13 and got.coverage == 13 / len(residue.plain("&nbsp;&nbsp;&nbsp;\n\n\nAccess denied"))


def test_residue_of_tables(spark):
    rows = list(enumerate(RESIDUE + FINE)) + [(1000, "word " * 50_000 + "\n\nAccess denied.")]
    assert {r.doc_id for r in residue.residue(docs(spark, rows)).where("n_found > 0").collect()} == {*range(len(RESIDUE)), 1000}
    assert {r.doc_id for r in residue.cleaned(docs(spark, rows)).collect()} == set(range(len(RESIDUE), len(RESIDUE + FINE)))
    assert 1000 in {r.doc_id for r in residue.cleaned(docs(spark, rows), 0.5).collect()}
    assert residue.residue(docs(spark, rows).limit(0)).count() == 0
