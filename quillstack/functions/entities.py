"""Decoding of HTML entities as SQL, for the queries' SQL; in Spark batches ``html.unescape`` does it."""

from __future__ import annotations

import html
import html.entities
from collections.abc import Iterable

_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _rows(pairs: Iterable[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)


def decoded_sql(source: str, key: str, name: str) -> str:
    """CTEs that end in ``name`` (``key``, text) with the entities of the text decoded, over a table of ``key`` (one unique column) and text."""
    small = _rows((str(n), html.unescape(f"&#{n};")) for n in range(1, 160) if html.unescape(f"&#{n};") != chr(n))
    number = "try_cast(case when ref ilike '&#x%' then '0x' || regexp_extract(ref, '&#[xX]([0-9a-fA-F]+)', 1) else regexp_extract(ref, '&#([0-9]+)', 1) end as bigint)"
    n = name
    return f"""{n}_cut as (select {key}, text, regexp_split_to_array(text, '{_ENTITY}') as b, regexp_extract_all(text, '{_ENTITY}') as m from {source} where text like '%&%'),
  {n}_names as (select * from (values {_rows(html.entities.html5.items())}) v(name, s)),
  {n}_refs as (select distinct unnest(m) as ref from {n}_cut),
  {n}_named as (select ref, max(k) as k from {n}_refs, range(2, 34) t(k), {n}_names where ref not like '&#%' and k < length(ref) and name = substr(ref, 2, cast(k as bigint)) group by ref),
  {n}_nums as (select ref, {number} as c from {n}_refs where ref like '&#%'),
  {n}_small as (select * from (values {small}) v(c, s)),
  {n}_plain as (
    select ref, s || substr(ref, cast(k + 2 as bigint)) as s from {n}_named join {n}_names on name = substr(ref, 2, cast(k as bigint))
    union all select ref, case when x.c is null or x.c = 0 or x.c > 1114111 or x.c between 55296 and 57343 then chr(65533) when v.s is not null then v.s
      when x.c between 64976 and 65007 or x.c & 65535 >= 65534 then '' else chr(cast(x.c as int)) end from {n}_nums x left join {n}_small v on v.c = cast(x.c as varchar)),
  {n}_parts as (select {key}, k, b[k] || coalesce(s, m[k], '') as part from (select {key}, b, m, unnest(range(1, len(b) + 1)) as k from {n}_cut) left join {n}_plain on ref = m[k]),
  {n} as (select {key}, string_agg(part, '' order by k) as text from {n}_parts group by {key} union all select {key}, text from {source} where text is null or text not like '%&%')"""
