"""Base64 ids of dictionary entries, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BASE64, CAPACITY, FIRST


def encoded_id(tier: Column, counter: Column) -> Column:
    """The id with number ``counter`` (from 0) of tier 1, 2 or 3; an error beyond the tier's capacity."""

    def of(t: int) -> Column:
        digit = lambda k: F.substring(F.lit(BASE64), F.pmod(F.floor(counter / 64**k), F.lit(64)).cast("int") + 1, F.lit(1))
        first = F.substring(F.lit(FIRST), F.floor(counter / 64**t).cast("int") + 1, F.lit(1))
        return F.concat(first, *[digit(k) for k in range(t - 1, -1, -1)])

    out = F.raise_error(F.concat(F.lit("no such id: tier "), tier.cast("string"), F.lit(", number "), counter.cast("string")))
    for t, most in CAPACITY.items():
        out = F.when((tier == t) & (counter >= 0) & (counter < most), of(t)).otherwise(out)
    return out


def tier_of(id_: Column, strict: bool = True) -> Column:
    """Tier of an id: 0 for one character, 4 for longer ones headed by -, else its length less 1; for any other an error, or null if not ``strict``."""
    multi = F.when(F.substring(id_, 1, 1) == "-", 4).when(F.length(id_).between(2, 4) & F.substring(id_, 1, 1).isin(*FIRST), F.length(id_) - 1)
    return F.when(F.length(id_) == 1, 0).otherwise(F.coalesce(multi, F.raise_error(F.concat(F.lit("unknown tier for id: "), id_)).cast("int")) if strict else multi)


def slot_tier(slot: Column) -> tuple[Column, Column]:
    """Tier and number within it of a place (from 0) in the run of all tiers' ids; null beyond the last."""
    a, b, c = CAPACITY.values()
    tier = F.when(slot < a, 1).when(slot < a + b, 2).when(slot < a + b + c, 3)
    counter = F.when(slot < a, slot).when(slot < a + b, slot - a).when(slot < a + b + c, slot - a - b)
    return tier, counter


def _value(char: Column) -> Column:
    return F.position(char, F.lit(BASE64)) - 1


def id_hex(id_: Column) -> Column:
    """An id packed into as many bytes as it has characters, in hex; the two highest bits of the first tell the tier."""
    head = _value(F.substring(id_, 1, 1)).bitwiseOR(F.shiftleft(F.length(id_) - 1, 6))
    rest = [F.when(F.length(id_) > k, F.lpad(F.hex(_value(F.substring(id_, k + 1, 1)).cast("long")), 2, "0")).otherwise("") for k in (1, 2, 3)]
    return F.concat(F.lpad(F.hex(head.cast("long")), 2, "0"), *rest)
