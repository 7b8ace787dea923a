"""What a model told and what was extracted, as one: filled where empty, upgraded where fuller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How dense a disclaimer is, from least to most.
DENSITIES = ("none", "low", "medium", "high")


def _size(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0))


def filled_list(own: Column, other: Column) -> Column:
    """The other list where one's own is empty or null."""
    return F.when(_size(own) > 0, own).otherwise(F.coalesce(other, own))


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def is_upgrade(candidate: Column, existing: Column) -> Column:
    """Whether a text is longer than another and has all its words."""
    return (F.length(existing) > 0) & (F.length(candidate) > F.length(existing)) & (F.size(F.array_except(_words(existing), _words(candidate))) == 0)


def upgraded_list(own: Column, other: Column) -> Column:
    """Each text of a list, or the first text of the other list that says it more fully; the other list where one's own is empty."""
    better = F.transform(own, lambda x: F.coalesce(F.get(F.filter(F.coalesce(other, F.array().cast("array<string>")), lambda y: is_upgrade(y, x)), F.lit(0)), x))
    return F.when(_size(own) > 0, better).otherwise(F.coalesce(other, own))


def once_by_key(texts: Column) -> Column:
    """Texts whose letters and digits were not seen before in the list."""
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    keyed = F.transform(texts, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    return F.transform(F.filter(F.transform(keyed, lambda p, i: F.struct(p["x"].alias("x"), (F.array_position(F.transform(keyed, lambda q: q["k"]), p["k"]) == i + 1).alias("first"))), lambda p: p["first"]), lambda p: p["x"])


def denser(a: Column, b: Column) -> Column:
    """The greater of two densities; an unknown one is none."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, DENSITIES)), c), F.lit(0))
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def filled_struct(own: Column, other: Column, lead: str, fields: list[str]) -> Column:
    """The other struct where one's own has no ``lead``; else one's own, its nulls filled from the other."""
    each = F.struct(own[lead].alias(lead), *[F.coalesce(own[f], other[f]).alias(f) for f in fields if f != lead])
    theirs = F.struct(other[lead].alias(lead), *[other[f].alias(f) for f in fields if f != lead])
    return F.when(own[lead].isNull(), theirs).otherwise(each)
