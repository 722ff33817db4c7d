"""Queries over the test tables, one or more for each operator, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as C
from .functions import caps, ids
from .functions import entities
from .functions import text as T
from .operators import codec, dictionary, fillers, frequency, library, ngrams, phrases, transcripts
from .plans.scratch import new_path, scratch, spread, table, written
from .sources import formats
from .sources import library as tables
from .sources import tables as files
from .sources import transcripts as scans

MIN_FREQ = 5
#: Lower case of the one letter that grows when lowered; DuckDB's lower leaves the dot out.
_LOW = "lower(replace({}, 'İ', 'i̇'))"


def _low(x: str) -> str:
    return _LOW.format(x)


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _docs(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(s, d, "documents", *(columns or ("doc_id", "text"))))


def _counts(s: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, written once since several steps read them."""
    return written(frequency.token_counts(_docs(s, d, "text")), "counts")


def _grams(s: SparkSession, d: str, most: int = 9) -> DataFrame:
    """Counts of frequent runs; with a least frequency they are written tables as they come."""
    return ngrams.ngram_counts(_docs(s, d, "text"), 2, most, MIN_FREQ)


# --- SQL that several queries share ---
#: Letters whose upper case isn't what they were; words with one are written out.
_CHANGED = r"[\x{130}\x{1c5}\x{1c8}\x{1cb}\x{1f2}\x{3f4}\x{1e9e}\x{2126}\x{212a}\x{212b}]"
_RX = T.TOKEN_RE2.replace("'", "''")
_TOK = f"tok as (select doc_id, unnest(l) as token, generate_subscripts(l, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '{_RX}') as l from documents))"
def _isword(x: str) -> str:
    return f"regexp_matches({x}, '^[{T.LETTER}{T.DIGIT}]')"


_CLASS = f"case when {_isword('token')} then 'word' when regexp_matches(token, '^[{T.SPACE}]') then 'whitespace' else 'punct' end"
_CNT = f"{_TOK}, counts as materialized (select {_low('token')} as token, count(*) as freq from tok group by 1)"
_WORDS = f"words as (select doc_id, list({_low('token')} order by pos) as w from tok where {_isword('token')} group by doc_id)"
def _gram(most: int) -> str:
    return f"""{_WORDS}, grams as materialized (
  select n, phrase, count(*) as freq from (
    select n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) as phrase
    from words, (select unnest(range(2, {most + 1})) as n) where len(w) >= n) group by n, phrase)"""


_SAVED = f"saved as materialized (select n, phrase, freq, n * 1.8::double as word_cost, 3 as phrase_cost, n * 1.8::double - 3 as savings_each, freq * (n * 1.8::double - 3) as savings_total from grams where freq >= {MIN_FREQ} and n * 1.8::double - 3 > 0)"
_PMI = """total as (select sum(freq)::double as total from counts),
  logs as (select phrase, sum(log2(coalesce(c.freq, 1)::double)) as logs from (select phrase, unnest(string_split(phrase, ' ')) as token from saved) p left join counts c using (token) group by phrase),
  pmis as (select s.*, log2(s.freq::double) + (n - 1) * log2(total) - logs as pmi from saved s join logs using (phrase), total)"""
_ABS = f"""parents as (select sub as phrase, max(freq) as parent_freq from (
    select freq, unnest([array_to_string(w[k:k + m - 1], ' ') for k in range(1, len(w) - m + 2)]) as sub
    from (select freq, n, string_split(phrase, ' ') as w from saved where n >= 3), (select unnest(range(2, 9)) as m) where m < n) group by sub),
  absorbed as (select s.phrase, s.freq, parent_freq from saved s join parents using (phrase) where parent_freq::double / s.freq >= {C.ABSORPTION}::double)"""
_B64 = C.BASE64


def _id_sql(tier: str, n: str) -> str:
    digit = lambda k: f"substr('{_B64}', cast(({n}) // {64**k} % 64 as int) + 1, 1)"
    first = lambda t: f"substr('{C.FIRST}', cast(({n}) // {64**t} as int) + 1, 1)"
    return f"case {tier} when 1 then {first(1)} || {digit(0)} when 2 then {first(2)} || {digit(1)} || {digit(0)} else {first(3)} || {digit(2)} || {digit(1)} || {digit(0)} end"


_T1, _T2 = C.CAPACITY[1], C.CAPACITY[2]
_TIER = f"case when slot < {_T1} then 1 when slot < {_T1 + _T2} then 2 else 3 end"
_NUMBER = f"case when slot < {_T1} then slot when slot < {_T1 + _T2} then slot - {_T1} else slot - {_T1 + _T2} end"
_SEED_ROWS = ", ".join(f"({_quoted([t])}, '{i}')" for t, i in C.TIER0_IDS.items())
_SEEDS = f"seeds as (select v.surface, v.base64_id, 0 as tier, coalesce(c.freq, 0) as freq, 'tier0' as kind from (values {_SEED_ROWS}) v(surface, base64_id) left join counts c on c.token = v.surface)"
_BAR = "bar as (select '|' as surface, 'gA' as base64_id, 1 as tier, coalesce((select freq from counts where token = '|'), 0) as freq, 'word' as kind)"
_V02 = f"""{_SEEDS}, {_BAR},
  slots as (select token as surface, freq, row_number() over (order by freq desc, token) as slot from counts where token not in ({_quoted(C.TIER0_IDS)}, '|')),
  v02 as (select * from seeds union all select * from bar union all select surface, {_id_sql(_TIER, _NUMBER)}, {_TIER}, freq, 'word' from slots)"""
_V03 = f"""{_SEEDS}, {_BAR},
  pool_words as (select token as surface, freq, 'word' as kind, row_number() over (order by freq desc, token) <= {C.TIER1_RESERVE} as first from counts where freq >= {MIN_FREQ} and token not in ({_quoted(C.TIER0_IDS)})),
  pool_phrases as (select phrase as surface, freq, 'phrase' as kind, false as first from kept where phrase not in (select token from counts)
    and not (n = 2 and len(list_filter(string_split(phrase, ' '), lambda w: w not in ({_quoted(C.TIER0_IDS)}))) = 0)),
  slots as (select *, row_number() over (order by first desc, freq desc, kind desc, surface) as slot from (select * from pool_words where surface <> '|' union all select * from pool_phrases)),
  ids as (select * from seeds union all select surface, {_id_sql(_TIER, _NUMBER)}, {_TIER}, freq, kind from slots union all select * from bar),
  ints as (select surface, row_number() over (order by freq desc, case kind when 'tier0' then 0 when 'word' then 1 else 2 end, surface) - 1 as int_id from ids where surface <> '|' or freq >= {MIN_FREQ}),
  v03 as materialized (select ids.*, int_id from ids left join ints using (surface))"""
_CAPS = f"""case when token = {_low('token')} then 'A' else array_to_string([substr('{_B64}', 1 + list_sum([
   (case when regexp_matches(substr(token, cast(k * 6 + j + 1 as bigint), 1), '^\\p{{Lu}}') then 1 << (5 - j) else 0 end) for j in range(0, 6)])::int, 1) for k in range(0, (length(token) + 5) // 6)], '') end"""


def _strip_sql() -> str:
    return f"""marked as (select *, lag(token) over w as before, lead(token) over w as after from tok window w as (partition by doc_id order by pos)),
  stripped as (select doc_id, pos, token from marked where not (token = ' ' and coalesce({_isword('before')}, false) and coalesce({_isword('after')}, false)))"""


_PIECES = f"{_CNT}, {_V02}, {_strip_sql()}, pieces as (select s.doc_id, s.pos, s.token, {_CAPS} as caps, {_low('s.token')} as low, v.base64_id, v.tier from stripped s left join v02 v on v.surface = {_low('s.token')})"
_SIZE = f"case when regexp_matches(token, '{_CHANGED}') then 5 + strlen(token) when base64_id is null and length(caps) > 255 then 5 + strlen(token) when base64_id is null then 4 + length(caps) + strlen(low) when token = low then strlen(base64_id) else 2 + length(caps) + strlen(base64_id) end"


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"


# --- queries ---
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@_query(f"with {_CNT} select token, freq from counts")
def token_frequency(s, d):
    return frequency.token_counts(_docs(s, d, "text"))


@_query(f"with {_TOK}, seen as (select {_low('token')} as token, count(*) as freq, min(doc_id * 10000000 + pos) as place from tok group by 1) select token, freq, place from seen")
def token_first_seen(s, d):
    c = frequency.first_seen_counts(_docs(s, d), "doc_id")
    return c.select("token", "freq", (F.col("first_seen.o") * 10_000_000 + F.col("first_seen.p")).alias("place"))


@_query(f"with {_CNT} select {_CLASS} as token_class, cast(sum(freq) as bigint) as n_tokens, count(*) as n_forms from counts group by 1")
def token_class_mix(s, d):
    return frequency.class_mix(_docs(s, d, "text"))


@_query(f"with {_CNT} select cast(sum(freq) as bigint) as total_tokens, count(*) as unique_forms from counts")
def token_totals(s, d):
    return frequency.totals(frequency.token_counts(_docs(s, d, "text")))


@_query(f"with {_CNT}, r as (select freq, row_number() over (order by freq desc, token) as rank from counts) select cutoff, cast(sum(freq) as bigint) as covered, round(sum(freq) * 100.0 / (select sum(freq) from counts), 4) as pct from r, (values (26), (1000), (4096), (10000)) v(cutoff) where rank <= cutoff group by cutoff")
def coverage_topk(s, d):
    return frequency.coverage(_counts(s, d))


@_query(f"""with {_CNT}, r as (select *, row_number() over (order by freq desc, token) as rank from counts)
  select rank, case token when ' ' then '<SPACE>' when chr(10) then '<NEWLINE>' when chr(9) then '<TAB>' else token end as shown, freq, cast(sum(freq) over (order by rank) as bigint) as running, token in ({_quoted(C.WORD_IDS)}) as in_tier0 from r where rank <= 60""")
def top_tokens_report(s, d):
    return frequency.top_tokens(_counts(s, d))


@_query(f"""with {_CNT}, r as (select *, row_number() over (order by freq desc, token) as rank from counts)
  select w.token, coalesce(freq, 0) as freq, rank from (select unnest([{_quoted(C.WORD_IDS)}]) as token) w left join r using (token) where rank is null or rank > 60""")
def tier0_missing(s, d):
    return frequency.missing_tier0(_counts(s, d))


@_query(f"select surface, count(*) as freq from (select unnest(regexp_extract_all(text, '[^{T.SPACE}]+')) as surface from documents) where length(surface) >= 2 and not regexp_matches(surface, '^[{T.DIGIT}]+$') group by surface")
def legacy_word_count(s, d):
    return frequency.surface_counts(_docs(s, d, "text"))


@_query(f"with {_TOK}, {_gram(9)} select n, phrase, freq from grams where freq >= {MIN_FREQ}")
def ngram_counts(s, d):
    return ngrams.ngram_counts(_docs(s, d, "text"), 2, 9, MIN_FREQ)


@_query(f"with {_TOK}, {_gram(9)} select n, count(*) as n_phrases, cast(sum(freq) as bigint) as n_occurrences from grams group by n")
def ngrams_by_length(s, d):
    return ngrams.length_totals(_docs(s, d, "text"))


@_query("""with chunk_tok as (select video_id, chunk_id, text from chunks where video_id is null or video_id not in (select video_id from eval_items where video_id is not null)),
  tok as (select row_number() over () as doc_id, text from chunk_tok) select count(*) as n_chunks, count(distinct text) as n_texts from tok""")
def heldout_chunks(s, d):
    kept = ngrams.held_back(table(s, d, "chunks", "video_id", "chunk_id", "text"), table(s, d, "eval_items", "video_id").where("video_id is not null"))
    return kept.agg(F.count("*").alias("n_chunks"), F.countDistinct("text").alias("n_texts"))


@_query(f"with {_TOK}, {_gram(9)}, {_SAVED} select n, phrase, freq, round(savings_each, 6) as savings_each, round(savings_total, 6) as savings_total from saved")
def ngram_savings(s, d):
    return ngrams.with_savings(_grams(s, d), MIN_FREQ).select("n", "phrase", "freq", F.round("savings_each", 6).alias("savings_each"), F.round("savings_total", 6).alias("savings_total"))


@_query(f"with {_TOK}, {_gram(9)}, {_SAVED}, r as (select *, row_number() over (order by round(savings_total, 6) desc, phrase) as rank from saved) select rank, phrase, freq, round(sum(savings_total) over (order by rank), 4) as cumulative from r where rank <= 100")
def savings_report(s, d):
    scored = ngrams.with_savings(_grams(s, d), MIN_FREQ).withColumn("savings_total", F.round("savings_total", 6))
    return ngrams.savings_report(scored).select("rank", "phrase", "freq", F.round("cumulative", 4).alias("cumulative"))


@_query(f"with {_CNT}, {_gram(9)}, {_SAVED}, {_PMI} select phrase, n, freq, round(pmi, 6) as pmi from pmis")
def phrase_pmi(s, d):
    return phrases.with_pmi(ngrams.with_savings(_grams(s, d), MIN_FREQ), _counts(s, d)).select("phrase", "n", "freq", F.round("pmi", 6).alias("pmi"))


@_query(f"with {_TOK}, {_gram(9)}, {_SAVED}, {_ABS} select phrase, freq, parent_freq from absorbed")
def absorbed_phrases(s, d):
    return phrases.absorbed(ngrams.with_savings(_grams(s, d), MIN_FREQ))


def _mined(s, d) -> DataFrame:
    return written(phrases.mined(_grams(s, d), _counts(s, d), MIN_FREQ), "mined")


_ALL = f"{_CNT}, {_gram(9)}, {_SAVED}, {_PMI}, {_ABS}, kept as (select *, savings_total * (1 + greatest(0, pmi) / 10) as score from pmis where phrase not in (select phrase from absorbed))"


@_query(f"with {_ALL} select row_number() over (order by round(score, 6) desc, phrase) as rank, phrase, n, freq, round(pmi, 6) as pmi, round(score, 6) as score from kept qualify rank <= 500")
def phrase_candidates_ranked(s, d):
    rows = phrases.report(_mined(s, d).withColumn("score", F.round("score", 6)), 500)
    return rows.select("rank", "phrase", "n", "freq", F.round("pmi", 6).alias("pmi"), "score")


@_query(f"select cast(n as bigint) as n, {_id_sql('1', 'least(n, 1279)')} as tier1, {_id_sql('2', 'n')} as tier2, {_id_sql('3', 'n * 61')} as tier3, cast(case when n < {_T1} then 2 when n < {_T1 + _T2} then 3 else 4 end as int) as phrase_bytes from range(0, 81920) t(n)")
def base64_ids(s, d):
    n = F.col("id")
    lit = F.lit
    return s.range(0, 81920).select(n.alias("n"), ids.encoded_id(lit(1), F.least(n, lit(1279))).alias("tier1"), ids.encoded_id(lit(2), n).alias("tier2"), ids.encoded_id(lit(3), n * 61).alias("tier3"), ngrams.phrase_bytes(n).alias("phrase_bytes"))


@_query(f"select id, cast(case when length(id) = 1 then 0 when id[1] = '-' then 4 when length(id) between 2 and 4 and id[1] in ({_quoted(C.FIRST)}) then length(id) - 1 end as int) as tier from (select distinct id from (select id from word_library union all select id from phrase_library))")
def detect_tier(s, d):
    all_ = table(s, d, "word_library", "id").unionByName(table(s, d, "phrase_library", "id")).distinct()
    return all_.select("id", ids.tier_of(F.col("id"), strict=False).alias("tier"))


@_query(f"select cast(case when n < {_T1} then 1 when n < {_T1 + _T2} then 2 when n < {sum(C.CAPACITY.values())} then 3 end as int) as tier, count(*) as n from range(0, 5500000) t(n) group by 1")
def tier_overflow(s, d):
    """Places of a dictionary by tier; those beyond the last tier have none."""
    return s.range(0, 5_500_000).groupBy(ids.slot_tier(F.col("id"))[0].alias("tier")).agg(F.count("*").alias("n"))


@_query(f"with {_CNT}, {_V02} select surface, base64_id, tier, freq, kind from v02")
def dictionary_v02(s, d):
    return dictionary.words_dictionary(_counts(s, d))


def _v03(s, d) -> tuple[DataFrame, DataFrame]:
    counts = _counts(s, d)
    with scratch(s) as made:
        mined = phrases.mined(_grams(s, d), counts, MIN_FREQ).select("phrase", "n", "freq")
        entries = written(dictionary.dictionary(counts, written(mined, "mined"), MIN_FREQ), "dictionary")
        made.pop()  # of the tables the dictionary stays
    return entries, counts


@_query(f"with {_ALL}, {_V03} select surface, base64_id, tier, freq, kind, int_id from v03")
def dictionary_v03(s, d):
    return _v03(s, d)[0]


@_query(f"with {_ALL}, {_V03} select kind, count(*) as n_entries, cast(sum(freq) as bigint) as freq from v03 group by kind")
def kind_counts(s, d):
    return dictionary.kind_counts(_v03(s, d)[0])


@_query(f"with {_CNT}, {_V02} select v.tier, count(*) as n_entries, cast(coalesce(sum(c.freq), 0) as bigint) as n_tokens, round(coalesce(sum(c.freq), 0) * 100.0 / (select sum(freq) from counts), 4) as pct from counts c full join v02 v on v.surface = c.token group by v.tier")
def tier_coverage(s, d):
    counts = _counts(s, d)
    return dictionary.tier_coverage(dictionary.words_dictionary(counts), counts)


_CUTS = f"cuts as (select place, profile, least(coalesce(size, n), n) as cut from (values {', '.join(f'({k}, {_quoted([p])}, {v or "null"})' for k, (p, v) in enumerate(C.PROFILES.items()))}) v(place, profile, size), (select count(int_id) as n from v03))"


@_query(f"with {_ALL}, {_V03}, {_CUTS} select place, profile, cut as content_size, cut as byte_fallback_start, cut + 256 as special_tokens_start, cut + 272 as total_vocab from cuts")
def profile_cuts(s, d):
    return dictionary.profile_cuts(s, dictionary.content_size(_v03(s, d)[0]))


@_query(f"with {_ALL}, {_V03}, {_CUTS} select profile, name, cut + 256 + k - 1 as id from cuts, (select unnest([{_quoted(C.SPECIAL_TOKENS)}]) as name, unnest(range(1, 17)) as k)")
def special_tokens(s, d):
    return dictionary.special_tokens(dictionary.profile_cuts(s, dictionary.content_size(_v03(s, d)[0])))


@_query(f"with {_ALL}, {_V03}, {_CUTS} select b as byte_value, printf('0x%02X', b) as hex, {', '.join(f'(select cut from cuts where profile = {_quoted([p])}) + b as id_in_{p}' for p in C.PROFILES)} from range(256) t(b)")
def byte_fallback(s, d):
    return dictionary.byte_fallback(dictionary.profile_cuts(s, dictionary.content_size(_v03(s, d)[0])))


def _flag_sql(profile: str) -> str:
    return f"""case when int_id < (select cut from cuts where profile = '{profile}') then 'Y' else 'N' end as "{profile}\""""


@_query(f"with {_ALL}, {_V03}, {_CUTS} select int_id as id, base64_id, surface, tier, freq, kind, {', '.join(map(_flag_sql, ('tiny', 'compact', 'standard', 'full')))} from v03 where int_id is not null")
def token_ids(s, d):
    entries = _v03(s, d)[0]
    return dictionary.token_ids(entries, dictionary.profile_cuts(s, dictionary.content_size(entries)))


_ESS = ", ".join(f"('{c}', {_quoted([t])}, '{k}')" for k, own in (("system", C.SYSTEM_IDS.items()), ("word", [(v, w) for w, v in C.WORD_IDS.items()]), ("structural", [(v, w) for w, v in C.MARK_IDS.items()])) for c, t in own)


@_query(f"with {_ALL}, {_V03} select char_id, e.surface, category, coalesce(c.freq, 0) as freq, int_id as integer_id, {', '.join(f'{_quoted(["Y"])} as profile_{p}' for p in C.PROFILES)} from (values {_ESS}) e(char_id, surface, category) left join counts c on c.token = e.surface left join v03 on v03.surface = e.surface")
def essentials(s, d):
    entries, counts = _v03(s, d)
    return dictionary.essentials(counts, entries)


_ASKED = ["the", "The", " ", "|", "subtitle", "no such word"]


@_query(f"with {_CNT}, {_V02} select a as asked, v.base64_id, v.tier, v.surface as found from (select unnest([{_quoted(_ASKED)}]) as a) left join v02 v on v.surface = lower(a)")
def spot_check(s, d):
    return dictionary.spot_check(dictionary.words_dictionary(_counts(s, d)), _ASKED)


@_query(f"with {_ALL}, {_V03} select count(*) as total_entries, {', '.join(f'count(*) filter (tier = {t}) as tier{t}_count' for t in range(4))}, count(*) filter (kind <> 'phrase') as words_in_dict, count(*) filter (kind = 'phrase') as phrases_in_dict, round(sum(freq) filter (kind <> 'phrase') * 100.0 / (select sum(freq) from counts), 4) as coverage_pct from v03")
def dictionary_stats(s, d):
    entries, counts = _v03(s, d)
    got = dictionary.stats(entries, counts)
    return got.select("total_entries", *[f"tier{t}_count" for t in range(4)], "words_in_dict", "phrases_in_dict", "coverage_pct")


@_query(f"with {_TOK} select distinct token, {_CAPS} as caps from tok where {_isword('token')}")
def caps_encode(s, d):
    words = _docs(s, d, "text").select(F.explode(T.tokens("text")).alias("token")).where(T.is_word(F.col("token"))).distinct()
    return words.select("token", caps.encoded_caps(F.col("token")).alias("caps"))


_BIT = f"(instr('{_B64}', substr(caps, cast((k - 1) // 6 + 1 as bigint), 1)) - 1) >> (5 - (k - 1) % 6) & 1"


@_query(f"with {_TOK}, w as (select distinct token, {_low('token')} as low, {_CAPS} as caps from tok where {_isword('token')}) select token, case when caps = 'A' then low else array_to_string([case when {_BIT} = 0 then substr(low, k, 1) when substr(low, k, 1) = 'ß' then 'SS' else upper(substr(low, k, 1)) end for k in range(1, length(low) + 1)], '') end as back from w")
def caps_decode(s, d):
    """All words with what their lower case and caps give: of a few letters not the word itself, so those words are written out."""
    words = _docs(s, d, "text").select(F.explode(T.tokens("text")).alias("token")).where(T.is_word(F.col("token"))).distinct()
    return words.select("token", caps.decoded_caps(F.lower("token"), caps.encoded_caps(F.col("token"))).alias("back"))


@_query(f"with {_PIECES}, least as (select surface from v02 where freq >= {MIN_FREQ}) select p.token, count(*) as freq, any_value(case when regexp_matches(p.token, '{_CHANGED}') then 'OOV:A:' || p.token else 'OOV:' || p.caps || ':' || p.low end) as oov from pieces p left join least on least.surface = p.low where least.surface is null group by p.token")
def oov_tokens(s, d):
    """All tokens outside of a dictionary with a least frequency, as written out."""
    known = dictionary.words_dictionary(_counts(s, d)).where(F.col("freq") >= MIN_FREQ)
    out = codec.word_pieces(_docs(s, d), known).where("base64_id is null")
    return out.groupBy("token").agg(F.count("*").alias("freq")).withColumn("oov", codec.piece(F.col("token"), F.lit(None).cast("string")))


_GROUPED = f"count(*) as n_tokens, {', '.join(f'count(*) filter (tier = {t}) as tier{t}' for t in range(4))}, count(*) filter (base64_id is not null and token <> low) as caps, count(*) filter (base64_id is null) as oov, cast(sum({_SIZE}) as bigint) as binary_bytes"


@_query(f"with {_PIECES}, langs as (select p.*, x.lang from pieces p join documents x using (doc_id)) select lang, {_GROUPED} from langs group by lang")
def encode_stats_by_lang(s, d):
    return codec.word_stats(_docs(s, d, "doc_id", "text", "lang"), dictionary.words_dictionary(_counts(s, d)), "lang")


@_query(f"with {_PIECES}, sizes as (select doc_id, cast(sum({_SIZE}) as bigint) as binary_bytes from pieces group by doc_id) select source, cast(sum(strlen(text)) as bigint) as src_bytes, cast(sum(binary_bytes + 8) as bigint) as enc_bytes, round(sum(strlen(text)) / sum(binary_bytes + 8)::double, 6) as ratio from documents join sizes using (doc_id) group by source")
def binary_size_by_source(s, d):
    docs = _docs(s, d, "doc_id", "text", "source")
    sizes = codec.word_stats(docs, dictionary.words_dictionary(_counts(s, d)), "doc_id").select("doc_id", (F.col("binary_bytes") + 8).alias("b"))
    both = docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("a")).join(sizes, "doc_id")
    return both.groupBy("source").agg(F.sum("a").alias("src_bytes"), F.sum("b").alias("enc_bytes"), F.round(F.sum("a") / F.sum("b"), 6).alias("ratio"))


@_query(f"with {_TOK}, {_strip_sql()} select doc_id, coalesce(n, 0) as n, coalesce(n - m, 0) as saved from documents left join (select doc_id, count(*) as n from tok group by doc_id) using (doc_id) left join (select doc_id, count(*) as m from stripped group by doc_id) using (doc_id)")
def implicit_space_savings(s, d):
    rows = _docs(s, d).select("doc_id", F.coalesce(F.size(T.tokens("text")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.size(T.units("text")), F.lit(0)).cast("long").alias("m"))
    return rows.select("doc_id", "n", (F.col("n") - F.col("m")).alias("saved"))


@_query("select doc_id, text from documents")
def implicit_space_restore(s, d):
    return _docs(s, d).select("doc_id", T.spaced(T.units("text")).alias("text"))


_WRITTEN = f"case when not regexp_matches(token, '{_CHANGED}') and (caps <> 'OOV' or base64_id is null) then case when base64_id is null then 'OOV:' || caps || ':' || low when token = low then base64_id else caps || ':' || base64_id end else 'OOV:A:' || token end"


@_query(f"with {_PIECES}, streams as (select doc_id, string_agg({_WRITTEN}, '|' order by pos) as body from pieces group by doc_id) select doc_id, case when text is not null then 'ELO|1|txt|' || coalesce(body, '') end as payload from documents left join streams using (doc_id)")
def encode_text_words_only(s, d):
    return codec.encoded_words(_docs(s, d), dictionary.words_dictionary(_counts(s, d)))


@_query("select doc_id, text from documents")
def decode_text_words_only(s, d):
    entries = written(dictionary.words_dictionary(_counts(s, d)), "dictionary")
    return codec.decoded_words(codec.encoded_words(_docs(s, d), entries), entries)


@_query(f"with {_CNT}, {_V02}, items as (select item_id, unnest(regexp_extract_all(text, '{_RX}')) as token from eval_items), words as (select i.token, v.surface from items i left join (select * from v02 where freq >= {MIN_FREQ}) v on v.surface = {_low('i.token')} where {_isword('token')}) select count(*) as n_words, count(*) filter (surface is null) as n_oov, round(count(*) filter (surface is null) * 100.0 / count(*), 4) as oov_pct from words")
def heldout_oov_rate(s, d):
    known = dictionary.words_dictionary(_counts(s, d)).where(F.col("freq") >= MIN_FREQ).select("surface")
    words = table(s, d, "eval_items", "text").select(F.explode(T.words("text")).alias("surface"))
    both = words.join(known.withColumn("known", F.lit(1)), "surface", "left")
    return both.agg(F.count("*").alias("n_words"), F.count_if(F.col("known").isNull()).alias("n_oov")).withColumn("oov_pct", F.round(F.col("n_oov") * 100 / F.col("n_words"), 4))


@_query(f"with {_ALL}, {_V03} select cast(count(*) as bigint) as n_ids, count(*) filter (int_id is not null and int_id < 1000) as n_own, cast(sum(case when int_id is not null and int_id < 1000 then 1 else strlen({_low('t.token')}) end) as bigint) as n_written from tok t left join v03 on v03.surface = {_low('t.token')}")
def profile_token_mix(s, d):
    entries = _v03(s, d)[0]
    tokens = _docs(s, d).select("doc_id", F.posexplode(F.transform(T.tokens("text"), F.lower)).alias("pos", "token"))
    rows = dictionary.profile_encoded(tokens, entries, 1000)
    return rows.agg(F.count_if(F.col("sub") == 0).alias("n_ids"), F.count_if(F.col("id") < 1000).alias("n_own"), F.count("*").alias("n_written"))


@_query(f"select doc_id, case '.' || lower(fmt) {' '.join(f"when '{f}' then '{C.FORMAT_ALIASES.get(f, f)}'" for f in C.FORMATS)} end as fmt from documents")
def format_detect(s, d):
    path = F.concat(F.lit("/corpus/a.b/"), F.col("doc_id").cast("string"), F.lit("."), F.upper("fmt"))
    return _docs(s, d, "doc_id", "fmt").select("doc_id", formats.format_of(path, strict=False).alias("fmt"))


_FILLER_ROWS = ", ".join(f"({_quoted([f])}, '{c}', {f.count(' ') + 1})" for c, own in C.FILLERS.items() for f in own)


@_query(f"""with {_TOK}, {_WORDS}, lex as (select * from (values {_FILLER_ROWS}) v(filler, filler_class, n)),
  spans as (select doc_id, k as pos, n, array_to_string(w[k:k + n - 1], ' ') as filler from words, (select unnest(range(1, 6)) as n), unnest(range(1, len(w) - n + 2)) t(k)),
  hits as (select doc_id, pos, filler_class, row_number() over (partition by doc_id, pos order by lex.n desc) as r from spans join lex using (filler))
  select filler_class, count(*) as n from hits where r = 1 group by filler_class""")
def filler_counts(s, d):
    return fillers.class_counts(_docs(s, d))


@_query("with stats as (select * from corpus_stats where epoch(processed_at) < 1756684800) select video_id, chunk_id, count(*) as n from chunks where video_id not in (select video_id from stats where video_id is not null) group by video_id, chunk_id")
def processed_anti_join(s, d):
    stats = table(s, d, "corpus_stats", "video_id", "processed_at").where("unix_seconds(processed_at) < 1756684800")
    return transcripts.unprocessed(table(s, d, "chunks", "video_id", "chunk_id").where("video_id is not null"), stats).groupBy("video_id", "chunk_id").agg(F.count("*").alias("n"))


@_query("select video_id, channel_name, chunk_count, token_count, cast(epoch(processed_at) as bigint) as at from corpus_stats qualify row_number() over (partition by video_id order by processed_at desc nulls last, channel_name desc nulls last, chunk_count desc nulls last, token_count desc nulls last) = 1")
def corpus_stats_latest(s, d):
    stats = table(s, d, "corpus_stats")
    return tables.merged("corpus_stats", stats, tables.empty(s, "corpus_stats")).withColumn("at", F.unix_seconds("processed_at")).drop("processed_at")


@_query("select id, surface, frequency, cast(epoch(created_at) as bigint) as at from word_library qualify row_number() over (partition by id order by created_at desc nulls last, surface desc nulls last, frequency desc nulls last) = 1")
def word_library_latest(s, d):
    rows = table(s, d, "word_library", "id", "surface", "frequency", "created_at")
    return transcripts.upserted(rows.limit(0), rows, "id", "created_at").withColumn("at", F.unix_seconds("created_at")).drop("created_at")


@_query("select video_id, chunk_id, coalesce(meta.speaker, 'unknown') as speaker, coalesce(meta.channel_name, 'unknown') as channel_name, coalesce(meta.title, '') as title, meta.start_hms as start_hms, round(meta.\"end\" - meta.\"start\", 6) as seconds from chunks")
def chunk_metadata(s, d):
    return table(s, d, "chunks", "video_id", "chunk_id", "meta").select("video_id", "chunk_id", *[F.coalesce(f"meta.{c}", F.lit(v)).alias(c) for c, v in (("speaker", "unknown"), ("channel_name", "unknown"), ("title", ""))], "meta.start_hms", F.round(F.col("meta.end") - F.col("meta.start"), 6).alias("seconds"))


@_query("select video_id, chunk_id, t as start, round(t - lag(t) over (partition by video_id order by chunk_id), 6) as delta from (select video_id, chunk_id, min(meta.\"start\") as t from chunks group by video_id, chunk_id)")
def timestamp_deltas(s, d):
    rows = table(s, d, "chunks", "video_id", "chunk_id", "meta").groupBy("video_id", "chunk_id").agg(F.min("meta.start").alias("start"))
    return rows.withColumn("delta", F.round(F.col("start") - F.lag("start").over(Window.partitionBy("video_id").orderBy("chunk_id")), 6))


_ROLE = " ".join(f"when '{k}' then '{v}'" for k, v in C.ROLES.items())


@_query(f"select pos_tag, case pos_tag {_ROLE} else 'other' end as role, count(*) as n from word_library group by 1, 2")
def role_mix(s, d):
    return table(s, d, "word_library", "pos_tag").groupBy("pos_tag").agg(F.count("*").alias("n")).withColumn("role", library.role_of(F.col("pos_tag")))


def _surfaces(s, d) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "word_library", "id", "surface", "lemma", "frequency", "pos_tag").where("surface is not null and trim(surface) != ''")
    surfaces = rows.groupBy(F.lower(F.trim("surface")).alias("surface")).agg(F.sum(F.coalesce("frequency", F.lit(0))).alias("freq"))
    analysed = rows.groupBy(F.lower(F.trim("surface")).alias("surface")).agg(F.min(F.struct("lemma", "pos_tag")).alias("r")).select("surface", F.col("r.lemma").alias("lemma"), F.col("r.pos_tag").alias("pos"))
    return surfaces, analysed


_LEMMA = """surf as (select lower(trim(surface)) as surface, cast(sum(coalesce(frequency, 0)) as bigint) as freq, min({'l': lemma, 'p': pos_tag}) as r from word_library where surface is not null and trim(surface) <> '' group by 1),
  lem as (select lower(r.l) as lemma, cast(sum(freq) as bigint) as frequency, arg_min(r.p, row(-freq, surface)) as pos_tag, arg_min(surface, row(-freq, surface)) as surface, count(*) as n_surfaces from surf where regexp_matches(surface, '^\\p{L}+$') and r.l is not null group by 1)"""


@_query(f"with {_LEMMA} select lemma, frequency, surface, n_surfaces from lem")
def lemma_rollup(s, d):
    return library.lemmas(*_surfaces(s, d)).where("lemma is not null").select("lemma", "frequency", "surface", F.size("surfaces").cast("long").alias("n_surfaces"))


_SLOT = "case when r <= 1000 then 1 when r <= 10000 then 2 else 3 end"
_IN = "case when r <= 1000 then r - 1 when r <= 10000 then r - 1001 else r - 10001 end"


@_query(f"with {_LEMMA}, ranked as (select *, row_number() over (order by frequency desc, lemma) as r from lem) select lemma, frequency, {_SLOT} as tier, {_id_sql(_SLOT, _IN)} as id from ranked")
def library_ids(s, d):
    return library.with_ids(library.lemmas(*_surfaces(s, d)).where("lemma is not null").select("lemma", "frequency")).select("lemma", "frequency", "tier", "id")


@_query(f"""with {_LEMMA}, ranked as (select *, row_number() over (order by frequency desc, lemma) as r from lem), own as (select *, {_SLOT} as tier, {_IN} as k from ranked),
  free as (select tier, n, row_number() over (partition by tier order by n) - 1 as k from (select 1 as tier, n, {_id_sql('1', 'n')} as id from range(0, 1280) t(n) union all select 2, n, {_id_sql('2', 'n')} from range(0, 30000) t(n) union all select 3, n, {_id_sql('3', 'n')} from range(0, 30000) t(n)) where id not in (select id from word_library where id like '%a'))
  select lemma, frequency, own.tier, {_id_sql('own.tier', 'free.n')} as id from own join free on free.tier = own.tier and free.k = own.k""")
def library_ids_registered(s, d):
    words = library.lemmas(*_surfaces(s, d)).where("lemma is not null").select("lemma", "frequency")
    taken = table(s, d, "word_library", "id").where("endswith(id, 'a')").select("id")
    return library.with_ids(words, taken).select("lemma", "frequency", "tier", "id")


_UNIT = "list_transform(embedding, lambda x: x::double / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) + 1e-9))"
_AXES = f"""unit as (select vec_id, label, {_UNIT} as u from embeddings), dims as (select label, i, avg(u[i]) as x from unit, (select unnest(range(1, (select len(embedding) from embeddings limit 1) + 1)) as i) where label < 6 group by label, i),
  raw as (select label, list(x order by i) as a from dims group by label), axes as (select label, list_transform(a, lambda x: x / (sqrt(list_sum(list_transform(a, lambda y: y * y))) + 1e-9)) as a from raw)"""
_EPA = f"{_AXES}, epa as (select vec_id, {', '.join(f'greatest(-1, least(1, {_dot_sql("u", f"(select a from axes where label = {a})")} - {_dot_sql("u", f"(select a from axes where label = {b})")})) as epa_{n}' for n, a, b in (('e', 0, 1), ('p', 2, 3), ('a', 4, 5)))} from unit)"


def _epa(s, d) -> DataFrame:
    vectors_ = table(s, d, "embeddings")
    axes = library.poles(vectors_.where("label < 6").select(F.col("label").cast("string").alias("pole"), "embedding"))
    return library.projected(vectors_, axes, {"epa_e": ("0", "1"), "epa_p": ("2", "3"), "epa_a": ("4", "5")})


@_query(f"with {_EPA} select vec_id, round(epa_e, 6) as epa_e, round(epa_p, 6) as epa_p, round(epa_a, 6) as epa_a from epa")
def epa_projection(s, d):
    return _epa(s, d).select("vec_id", *[F.round(c, 6).alias(c) for c in ("epa_e", "epa_p", "epa_a")])


_STAGE = "list_transform([" + ", ".join(f"[{a}, {b}, {c}]" for a, b, c in C.STAGES.values()) + "], lambda c: sqrt((epa_e - c[1]) * (epa_e - c[1]) + (epa_p - c[2]) * (epa_p - c[2]) + (epa_a - c[3]) * (epa_a - c[3])))"


@_query(f"select id, epa_e, case when epa_e is null or epa_p is null or epa_a is null then null else [{_quoted(C.STAGES)}][list_position({_STAGE.replace('[0.', '[0.')}, list_min({_STAGE}))] end as stage from word_library")
def stage_classify(s, d):
    return table(s, d, "word_library", "id", "epa_e", "epa_p", "epa_a").select("id", "epa_e", library.stage_of(F.col("epa_e"), F.col("epa_p"), F.col("epa_a")).alias("stage"))


@_query(f"with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id, round({_dot_sql('embedding', 'q')}, 6) as score from embeddings, q) select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10")
def knn_inner_product(s, d):
    vectors_ = table(s, d, "embeddings", "vec_id", "embedding")
    return library.nearest_vectors(vectors_, vectors_.where("vec_id % 50 = 0"))


@_query(f"select vec_id, round(sqrt({_dot_sql('embedding', 'embedding')}), 6) as length from embeddings")
def vector_lengths(s, d):
    return library.lengths(table(s, d, "embeddings", "vec_id", "embedding"))


@_query("select id, count(*) as n from word_library group by id having count(*) > 1")
def duplicate_ids(s, d):
    return table(s, d, "word_library", "id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def _chunks(s, d) -> DataFrame:
    return table(s, d, "chunks", "video_id", "chunk_id", "text", "meta")


_SPLIT = f"[^{T.SPACE}]+"
_FIRST, _LAST = C.REPEAT_WORDS
_LEAST, _MOST = C.BOUNDARY_WORDS
#: Chunks word by word: at each place the longest phrase that stands twice or more in a row is kept once; then chunk by
#: chunk what begins like the end of what was left of the one before falls away.
_CLEAN = f"""once as (select row_number() over () as id, video_id, chunk_id, text from (select video_id, chunk_id, min(text) as text from chunks where video_id is not null and chunk_id is not null group by all) where regexp_matches(text, '{_SPLIT}')),
  {entities.decoded_sql("once", "id", "plain")},
  start as (select id, regexp_extract_all(text, '{_SPLIT}') as w from plain),
  walk as (
    select id, 0::bigint as p, []::varchar[] as kept from start
    union all select id, p + step * copies, kept || w[p + 1:p + step] from (
      select *, case when step = 1 then 1 else coalesce(list_min(list_filter(range(1, (len(w) - p) // step), lambda k: w[p + k * step + 1:p + (k + 1) * step] <> w[p + 1:p + step])), (len(w) - p) // step) end as copies
      from (select id, p, kept, w, coalesce(list_max(list_filter(range({_FIRST}, {_LAST + 1}), lambda n: p + 2 * n <= len(w) and w[p + 1:p + n] = w[p + n + 1:p + 2 * n])), 1) as step from walk join start using (id) where p < len(w)))),
  words_once as (select id, kept as w from walk join start using (id) where p >= len(w)),
  placed as (select video_id, chunk_id, w, row_number() over (partition by video_id order by chunk_id) as r from words_once join once using (id)),
  left_over as (
    select video_id, chunk_id, r, w as kept from placed where r = 1
    union all select video_id, chunk_id, r, w[cut + 1:] from (
      select q.video_id, q.chunk_id, q.r, q.w, coalesce(list_max(list_filter(range({_LEAST}, {_MOST + 1}), lambda n: n <= len(b.kept) and n <= len(q.w) and b.kept[len(b.kept) - n + 1:] = q.w[1:n])), 0) as cut
      from left_over b join placed q on q.video_id = b.video_id and q.r = b.r + 1)),
  clean as (select video_id, chunk_id, array_to_string(kept, ' ') as text, len(kept) as n_words from left_over where len(kept) > 0)"""


@_query(f"with recursive {_CLEAN} select video_id, chunk_id, text, n_words from clean")
def asr_dedup(s, d):
    return transcripts.cleaned(_chunks(s, d))


@_query(f"""with recursive {_CLEAN}, counts as (select video_id, sum(n_words) as n from clean group by video_id)
  select video_id, coalesce(min(meta.channel_name), 'unknown') as channel_name, count(distinct chunk_id) as chunk_count, cast(coalesce(any_value(n), 0) as bigint) as token_count from chunks left join counts using (video_id) where video_id is not null and chunk_id is not null group by video_id""")
def corpus_stats_built(s, d):
    rows = _chunks(s, d)
    return transcripts.corpus_stats(rows, written(transcripts.cleaned(rows), "clean"))


#: Units of each document with the dictionary's phrases as one: of overlapping ones, from the left, the longest that begins first.
_UNITS = f"""{_strip_sql()},
  flat as (select doc_id, token, {_isword('token')} as word, row_number() over (partition by doc_id order by pos) as i from stripped),
  in_runs as (select doc_id, i, token, i - row_number() over (partition by doc_id order by i) as run from flat where word),
  word_runs as (select doc_id, min(i) as i, list(token order by i) as w from in_runs group by doc_id, run),
  entries as materialized (select surface, base64_id, tier from v03),
  spans as (select doc_id, i + k - 1 as i, n, array_to_string(w[k:k + n - 1], ' ') as token from (select doc_id, i, w, n, unnest(range(1, len(w) - n + 2)) as k from word_runs, range(2, {C.MOST_PHRASE_WORDS + 1}) t(n) where len(w) >= n)),
  matches as (select doc_id, i, max(n) as n, arg_max(spans.token, n) as token from spans join entries on surface = {_low('spans.token')} group by doc_id, i),
  groups as (select *, sum(cast(coalesce(i >= far, true) as int)) over (partition by doc_id order by i) as g from (select *, max(i + n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as far from matches)),
  lists as (select doc_id, list({{'i': i, 'n': n, 'e': 0::bigint, 'chosen': []::bigint[]}} order by i) as l from groups group by doc_id, g),
  picked as (select doc_id, unnest(list_reduce(l, lambda a, x: case when x.i >= a.e then {{'i': x.i, 'n': x.n, 'e': x.i + x.n, 'chosen': list_append(a.chosen, x.i)}} else a end, {{'i': 0::bigint, 'n': 0::bigint, 'e': 0::bigint, 'chosen': []::bigint[]}}).chosen) as i from lists),
  taken as (select doc_id, i, n, token from picked join matches using (doc_id, i)),
  inner_ as (select doc_id, unnest(range(i, i + n)) as i from taken),
  units as (select doc_id, i, token from taken union all select f.doc_id, f.i, f.token from flat f anti join inner_ using (doc_id, i)),
  coded as (select doc_id, i, token, {_CAPS} as caps, {_low('token')} as low, base64_id, tier, not regexp_matches(token, '{_CHANGED}') as back from units left join entries on surface = {_low('token')})"""
_TEXT_PIECE = "case when base64_id is not null and back and (token = low or caps <> 'OOV') then case when token = low then base64_id else caps || ':' || base64_id end when back then 'OOV:' || caps || ':' || low else 'OOV:A:' || token end"
_TEXT_KNOWN = "(base64_id is not null and back and (token = low or caps <> 'OOV'))"
_KNOWN = "(base64_id is not null and back)"
_HEX_ID = f"printf('%02X', (tier << 6) | (instr('{_B64}', base64_id[1]) - 1)) || array_to_string(list_transform(range(2, length(base64_id) + 1), lambda k: printf('%02X', instr('{_B64}', base64_id[k]) - 1)), '')"
_PLAIN = "(not back or length(caps) > 255)"
_BODY = f"case when {_PLAIN} then token else low end"
_OOV_CAPS = f"case when {_PLAIN} then 'A' else caps end"
_HEX = f"""case when {_KNOWN} then case when token = low then '' else 'FE' || printf('%02X', length(caps)) || hex(encode(caps)) end || {_HEX_ID}
  else 'FF' || printf('%02X', length({_OOV_CAPS})) || hex(encode({_OOV_CAPS})) || printf('%02X%02X', strlen({_BODY}) & 255, strlen({_BODY}) >> 8) || hex(encode({_BODY})) end"""
_TOO_LONG = f"(not {_KNOWN} and strlen({_BODY}) > 65535)"


@_query(f"with {_CNT}, {_V02}, {_strip_sql()}, entries as (select * from v02 where freq >= {MIN_FREQ}), words as (select distinct token from stripped), coded as (select token, {_CAPS} as caps, {_low('token')} as low, base64_id, tier, not regexp_matches(token, '{_CHANGED}') as back from words left join entries on surface = {_low('token')}) select token, base64_id is null as oov, case when not {_TOO_LONG} then {_HEX} end as hex from coded")
def binary_pieces(s, d):
    """All tokens as they stand in the binary stream, in hex, with a dictionary of a least frequency; null for what doesn't fit."""
    known = dictionary.words_dictionary(_counts(s, d)).where(F.col("freq") >= MIN_FREQ)
    rows = codec.word_pieces(_docs(s, d), known).select("token", "base64_id").distinct()
    return rows.select("token", F.col("base64_id").isNull().alias("oov"), codec.piece_hex(F.col("token"), F.col("base64_id")).alias("hex"))


def _streams(payload: str, known: str, bad: str) -> str:
    tiers = ", ".join(f"count(*) filter ({known} and tier = {t}) as tier{t}" for t in range(4))
    return f"""with {_ALL}, {_V03}, {_UNITS}, streams as (
    select doc_id, {payload} as body, count(*) as n_tokens, {tiers}, count(*) filter ({known} and token <> low) as caps, count(*) filter (not {known}) as oov, bool_or({bad}) as bad from coded group by doc_id)"""


def _stream_sql(payload: str, known: str, bad: str, whole: str, size: str, fmt: str) -> str:
    """All columns of encoded documents: ``payload`` aggregates a document's pieces, ``whole`` is the stream and ``size`` its bytes."""
    sums = ["n_tokens", "tier0", "tier1", "tier2", "tier3", "caps", "oov"]
    value = lambda x: f"case when text is null or coalesce(bad, false) then null else {x} end"
    return f"""{_streams(payload, known, bad)}
  select doc_id, {value(whole)} as payload, {fmt} as fmt, {", ".join(f"{value(f'coalesce({x}, 0)')} as {x}" for x in sums)}, strlen(text) as src_bytes, {value(size)} as enc_bytes,
    case when bad then 'a token is too long for the binary stream' end as error from documents left join streams using (doc_id)"""


_FMT = "coalesce('.' || lower(documents.fmt), '.txt')"
_TEXT_OUT = "'ELO|1|' || ltrim(" + _FMT + ", '.') || '|' || coalesce(body, '')"
_HEX_OUT = "'454C4F0203747874' || coalesce(body, '')"


_TEXT_BODY, _HEX_BODY = f"string_agg({_TEXT_PIECE}, '|' order by i)", f"string_agg({_HEX}, '' order by i)"


@_query(_stream_sql(_TEXT_BODY, _TEXT_KNOWN, "false", _TEXT_OUT, f"strlen({_TEXT_OUT})", _FMT))
def encode_phrase_stream(s, d):
    return codec.encoded(_docs(s, d, "doc_id", "text", "fmt").withColumn("fmt", F.concat(F.lit("."), F.lower("fmt"))), _v03(s, d)[0])


@_query(_stream_sql(_HEX_BODY, _KNOWN, _TOO_LONG, _HEX_OUT, f"length({_HEX_OUT}) // 2", "'.txt'"))
def encode_binary_stream(s, d):
    """The binary streams, their payload shown in hex."""
    return codec.encoded(_docs(s, d), _v03(s, d)[0], binary=True).withColumn("payload", F.hex("payload"))


@_query("select doc_id, coalesce(text, null) as text from documents")
def decode_phrase_stream(s, d):
    entries = _v03(s, d)[0]
    return codec.there_and_back(_docs(s, d), entries).select("doc_id", "text")


@_query("select doc_id, text from documents")
def decode_binary_stream(s, d):
    entries = _v03(s, d)[0]
    return codec.there_and_back(_docs(s, d), entries, binary=True).select("doc_id", "text")


@_query("select doc_id, case when text is null then null else true end as same from documents")
def roundtrip_binary(s, d):
    return codec.round_trip(_docs(s, d), _v03(s, d)[0], binary=True)


@_query("select doc_id, case when text is null then null else true end as same from documents")
def roundtrip_text(s, d):
    return codec.round_trip(_docs(s, d), _v03(s, d)[0])


@_query(f"{_streams(_HEX_BODY, _KNOWN, _TOO_LONG)} select count(*) as n_docs, cast(sum(strlen(text)) as bigint) as src_bytes, cast(sum(case when not coalesce(bad, false) then length({_HEX_OUT}) // 2 end) as bigint) as enc_bytes, bool_and(not coalesce(bad, false)) as all_same from documents left join streams using (doc_id) where text is not null")
def codec_totals(s, d):
    """One row of a benchmark of the binary stream: documents, bytes before and after, and whether all came back."""
    rows = codec.timed(_docs(s, d), _v03(s, d)[0], binary=True)
    return codec.bench_totals(rows).select("n_docs", "src_bytes", "enc_bytes", "all_same")


@_query("select doc_id, md5(text) as digest from documents")
def decoded_bytes(s, d):
    """The digest of each document's bytes after encoding and decoding them."""
    entries = written(dictionary.words_dictionary(_counts(s, d)), "dictionary")
    docs = _docs(s, d).select("doc_id", F.encode("text", "UTF-8").cast("string").alias("text"))
    back = codec.decoded(codec.encoded(docs, entries, binary=True), entries, binary=True)
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


_HEADS = {0: ("ELO|1|txt|", None), 1: ("ELO|9|txt|A", "unknown version: 9"), 2: ("XYZ|1|txt|A", "not a text stream"), 3: ("ELO|1", "not a text stream")}


@_query(f"select doc_id, case doc_id % 4 {' '.join(f'when {k} then {_quoted([e]) if e else chr(39) * 2}' for k, (_, e) in _HEADS.items())} end as error from documents")
def stream_headers(s, d):
    """What is said of streams with a good header, another version, another magic, and none."""
    heads = F.array(*[F.lit(h) for h, _ in _HEADS.values()])
    streams = _docs(s, d, "doc_id").select("doc_id", F.get(heads, (F.col("doc_id") % 4).cast("int")).alias("payload"))
    entries = s.createDataFrame(list(C.TIER0_IDS.items()), "surface string, base64_id string")
    return codec.decoded(streams, entries).select("doc_id", F.coalesce("error", F.lit("")).alias("error"))


@_query(f"with {_CNT} select token, freq from counts")
def frequency_file(s, d):
    path = new_path(s, "frequencies")
    files.write_frequencies(_counts(s, d), path)
    return files.read_frequencies(s, path)


@_query(f"with {_TOK}, {_gram(9)}, {_SAVED} select n, phrase, freq from saved")
def ngram_file(s, d):
    """Runs written to two files, of 2 to 5 and of 6 to 9 words, and read together."""
    scored, paths = written(ngrams.with_savings(_grams(s, d), MIN_FREQ), "scored"), [new_path(s, "ngrams"), new_path(s, "ngrams")]
    files.write_ngrams(scored.where("n <= 5"), paths[0])
    files.write_ngrams(scored.where("n > 5"), paths[1])
    return files.read_ngrams(s, *paths)


@_query(f"with {_ALL} select phrase, n, freq, cast(printf('%.2f', pmi) as double) as pmi from kept")
def phrase_file(s, d):
    path = new_path(s, "phrases")
    files.write_phrases(_mined(s, d), path)
    return files.read_phrases(s, path)


@_query(f"with {_CNT}, {_gram(9)}, {_SAVED}, {_PMI}, strong as (select * from pmis where pmi >= 12), {_ABS.replace('saved', 'strong')} select phrase, n, freq, round(pmi, 6) as pmi from strong where phrase not in (select phrase from absorbed)")
def phrases_over_pmi(s, d):
    """Phrases with a least mutual information."""
    return phrases.mined(_grams(s, d), _counts(s, d), MIN_FREQ, min_pmi=12.0).select("phrase", "n", "freq", F.round("pmi", 6).alias("pmi"))


_ESCAPED = "array_to_string([case when c = chr(92) then chr(92) || chr(92) when c = chr(10) then '\\n' when c = chr(9) then '\\t' when c = chr(13) then '\\r' when unicode(c) between 32 and 126 then c when unicode(c) < 256 then printf('\\x%02x', unicode(c)) when unicode(c) < 65536 then printf('\\u%04x', unicode(c)) else printf('\\U%08x', unicode(c)) end for c in [substr(token, k, 1) for k in range(1, length(token) + 1)]], '')"


@_query(f"with {_CNT} select token, {_ESCAPED} as escaped, token as back from counts")
def token_escapes(s, d):
    rows = _counts(s, d).select("token", files.escaped("token").alias("escaped"))
    return rows.select("token", "escaped", files.unescaped("escaped").alias("back"))


#: Files of transcripts: a video's chunks in parts of 100 numbers, each a file of its own.
_PARTS = "select video_id || '-' || (chunk_id // 100) as video_id, row_number() over (partition by video_id, chunk_id // 100 order by chunk_id) - 1 as chunk_id, text from (select video_id, chunk_id, min(text) as text from chunks where video_id is not null and chunk_id is not null group by all)"


def _transcript_files(s: SparkSession, d: str) -> str:
    """A folder of transcript files with the table's chunks; each file has 100 chunks at most."""
    rows = table(s, d, "chunks", "video_id", "chunk_id", "text").where("video_id is not null and chunk_id is not null").groupBy("video_id", "chunk_id").agg(F.min("text").alias("text"))
    name = F.concat_ws("-", "video_id", F.floor(F.col("chunk_id") / 100).cast("string"))
    of = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: F.struct(x.text.alias("text")))
    path = new_path(s, "transcripts")
    rows.groupBy(name.alias("video_id")).agg(of.alias("chunks")).withColumn("file", F.col("video_id")).write.partitionBy("file").json(path)
    return path


@_query(_PARTS)
def raw_chunk_texts(s, d):
    return scans.raw_texts(scans.read_files(s, _transcript_files(s, d))).select("video_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text")


@_query(f"with recursive chunks_ as ({_PARTS}), {_CLEAN.replace('from chunks where', 'from chunks_ where')} select video_id, chunk_id, text, 'unknown' as channel_name, chunk_id as meta_chunk_id from clean")
def transcript_scan(s, d):
    """Transcript files scanned: chunks without repeats and overlaps, with their metadata."""
    got = scans.scan(s, _transcript_files(s, d))
    return got.select("video_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", "meta.channel_name", F.col("meta.chunk_id").cast("long").alias("meta_chunk_id"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Encoding statistics by language: tokens by tier, words without entry, bytes before and after, and their ratio."""
    docs = _docs(s, d, "doc_id", "text", "lang")
    entries = written(dictionary.words_dictionary(_counts(s, d)), "dictionary")
    sizes = docs.groupBy(F.col("lang").alias("own")).agg(F.sum(F.octet_length("text").cast("long")).alias("src_bytes"))
    return codec.word_stats(docs, entries, "lang").join(sizes, F.col("lang").eqNullSafe(F.col("own"))).drop("own").withColumn("ratio", F.round(F.col("src_bytes") / F.col("binary_bytes"), 4))

