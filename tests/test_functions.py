import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.constants import BASE64, CAPACITY, RESERVED_IDS, SYSTEM_IDS, TIER0_IDS
from quillstack.functions import caps, ids, scanner, vectors
from quillstack.functions import text as T
from quillstack.functions.register import register

EDGES = ["", " ", "\n", "a", "don't", "'a'", "a'", "v1.2.3-rc1", "_leading", "x_y", "1.5", "a.b.", "...", "a  b", "\r\n", "\t x", "É'é", "a'1", "1'a", "你好 мир", "👨‍👩‍👧 🇫🇷", "é", "İstanbul ẞ K ǅ ﬁn ① ²", "a\x1cb", "|", "OOV:A:x", "<|endoftext|>", "﻿x​"]


def scanned(text):
    """The token rule restated character by character."""
    space = lambda c: c.isspace()
    word = lambda c: c.isalpha() or c.isdigit()
    out, i = [], 0
    while i < len(text):
        j = i + 1
        if space(text[i]):
            while j < len(text) and space(text[j]):
                j += 1
        elif word(text[i]):
            while j < len(text):
                if word(text[j]):
                    j += 1
                elif j + 1 < len(text) and (text[j] == "'" and text[j - 1].isalpha() and text[j + 1].isalpha() or text[j] in "._" and word(text[j - 1]) and word(text[j + 1])):
                    j += 2
                else:
                    break
        out.append(text[i:j])
        i = j
    return out


def test_known_tokens():
    assert scanner.tokens("v1.2.3-rc1") == ["v1.2.3", "-", "rc1"]
    assert scanner.tokens("boys'") == ["boys", "'"]
    assert scanner.tokens("_leading") == ["_", "leading"]
    assert scanner.units("you  know it . a") == ["you", "  ", "know", "it", " ", ".", " ", "a"]


@settings(deadline=None)
@given(st.text(st.sampled_from("ab1'._ \n\t!éİ²你😀\x1c "), max_size=40))
def test_scanner_is_the_rule(text):
    assert scanner.tokens(text) == scanned(text)


def test_column_tokens(spark):
    random.seed(2)
    texts = EDGES + ["".join(random.choice("ab1'._ \n!é²你😀 ") for _ in range(50)) for _ in range(300)] + ["a.b" * 40_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.tokens("t").alias("x"), T.units("t").alias("u"), T.spaced(T.units("t")).alias("s")).collect()
    for r in rows:
        assert "".join(r.x) == texts[r.k] == r.s
        assert r.x == scanned(texts[r.k])
        assert r.u == scanner.units(texts[r.k])
    assert spark.createDataFrame([(None,)], "t string").select(T.tokens("t")).first()[0] is None


def test_token_class(spark):
    got = spark.createDataFrame([("a",), ("1",), (" ",), ("\n",), (".",), ("",), ("²",), ("_",)], "t string").select(T.token_class(F.col("t"))).collect()
    assert [r[0] for r in got] == ["word", "word", "whitespace", "whitespace", "punct", "empty", "word", "punct"]


KNOWN = {"hello": "A", "Hello": "g", "NASA": "8", "iPhone": "Q", "McDonald": "oA", "": "A", "A" * 7: "_g"}


def test_caps(spark):
    for word, code in KNOWN.items():
        assert caps.caps_of(word) == (word.lower(), code)
        assert caps.word_of(word.lower(), code) == word
    df = spark.createDataFrame([(w,) for w in KNOWN], "w string").select("w", caps.encoded_caps(F.col("w")).alias("c"), caps.encoded_oov(F.col("w")).alias("o"))
    rows = df.withColumn("back", caps.decoded_oov(F.col("o"))).collect()
    assert {r.w: r.c for r in rows} == KNOWN and all(r.back == r.w for r in rows)
    with pytest.raises(Exception, match="out-of-vocabulary"):
        spark.sql("select 'OOV:A' as t").select(caps.decoded_oov(F.col("t"))).collect()


@settings(deadline=None)
@given(st.text(st.characters(codec="ascii"), max_size=30))
def test_caps_come_back(word):
    assert caps.word_of(*caps.caps_of(word)) == word


def test_ids(spark):
    known = {(1, 0): "gA", (1, 63): "g_", (1, 64): "hA", (2, 0): "gAA", (3, 0): "gAAA", (1, CAPACITY[1] - 1): "z_", (3, CAPACITY[3] - 1): "z___"}
    df = spark.createDataFrame([(*k, v) for k, v in known.items()], "t int, n long, id string")
    for r in df.select("id", "t", ids.encoded_id(F.col("t"), F.col("n")).alias("got"), ids.tier_of(F.col("id")).alias("tier"), ids.id_hex(F.col("id")).alias("hex")).collect():
        assert (r.got, r.tier) == (r.id, r.t)
        assert bytes.fromhex(r.hex) == bytes([BASE64.index(r.id[0]) | r.t << 6, *map(BASE64.index, r.id[1:])])
    for bad in ((1, CAPACITY[1]), (4, 0), (1, -1)):
        with pytest.raises(Exception, match="no such id"):
            spark.createDataFrame([bad], "t int, n long").select(ids.encoded_id(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in spark.createDataFrame([("T",), ("-",), ("-AAA",)], "id string").select(ids.tier_of(F.col("id"))).collect()] == [0, 0, 4]
    with pytest.raises(Exception, match="unknown tier"):
        spark.createDataFrame([("AAAAA",)], "id string").select(ids.tier_of(F.col("id"))).collect()


def test_constants():
    assert len(TIER0_IDS) == 53 and len(SYSTEM_IDS) + len(TIER0_IDS) == 58
    assert not set(RESERVED_IDS) & {*SYSTEM_IDS, *TIER0_IDS.values()}
    assert CAPACITY == {1: 1280, 2: 81_920, 3: 5_242_880}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.norm(F.col("a")).alias("n")).collect()
    assert [r.d for r in got] == [3.0, None, None] and got[0].n == 5.0


def test_registered(spark):
    register(spark, spark.createDataFrame([("a", "A"), ("b", "gA")], "surface string, base64_id string"))
    r = spark.sql("select sc_tokenize('a b!') as t, sc_encode_caps('NASA') as c, sc_decode_caps('nasa', '8') as w, sc_encode('A b c', 'txt') as e, sc_decode(sc_encode('A b c', 'txt')) as d, sc_tokenize(null) as n").first()
    assert (r.t, r.c, r.w, r.e, r.d, r.n) == (["a", " ", "b", "!"], "8", "NASA", "ELO|1|txt|g:A|gA|OOV:A:c", "A b c", None)
