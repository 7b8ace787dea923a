"""Names that are variants of shorter ones.

A name is a variant of a base when the base's words are found in it in order; a
word of two letters or more may also stand for as many words in a row that
begin with its letters. Both are read as lower-case words. A base has to be
shorter, and long enough to say something.

Every word of a base must be found, so a base asks with one of its words only:
the one that the fewest names have, as a word or as initials in a row. No name
is paired with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.plans.shared import Scratch

LEAST_CHARS = 4  # of a base, without blanks


def words_found(candidate: Column, base: Column) -> Column:
    """Whether the words of ``base`` are found in ``candidate`` in order, word by word from the left.

    A word that is there as it is counts before one that is spelled out.
    """
    initials = F.array_join(F.transform(candidate, lambda w: F.left(w, F.lit(1))), "")
    start = F.struct(F.lit(0).alias("free"), F.lit(0).alias("found"))  # the first word that is not used, and how many of the base's are found

    def step(s: Column, i: Column) -> Column:
        wanted = F.get(base, s["found"])
        size = F.length(wanted)
        same = F.get(candidate, i) == wanted
        spelled = (size >= 2) & (F.substr(initials, i + 1, size) == wanted)
        after = F.when(same, i + 1).when(spelled, i + size)
        takes = (i >= s["free"]) & wanted.isNotNull() & after.isNotNull()
        return F.when(takes, F.struct(after.alias("free"), (s["found"] + 1).alias("found"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.size(candidate) - 1), start, step, lambda s: s["found"] == F.size(base))


def _initials(words: Column, longest: Column) -> Column:
    """The initials of every run of two words or more, up to a length."""
    letters = F.transform(words, lambda w: F.left(w, F.lit(1)))
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(longest, n - i + 1), F.lit(1))), lambda k: F.array_join(F.slice(letters, i, k), ""))))
    return F.filter(runs, lambda r: F.length(r) >= 2)


def base_names(names: DataFrame, name_col: str = "name", brand_col: str | None = None, least_chars: int = LEAST_CHARS, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``name, base`` of every name that is a variant of another one, with its longest base.

    Of equally long bases the first by name is taken. Names whose brands are
    both known and differ are no variants of each other. Names are compared by
    their lower-case words; ``dropped`` are names that are no base. Names
    without words, and equal names, have no base among each other.
    """
    scratch = Scratch(names.sparkSession, "variants")
    brand = F.lit(None).cast("string") if brand_col is None else F.nullif(X.normalize_name(F.col(brand_col)), F.lit(""))
    rows = names.select(X.normalize_name(F.col(name_col)).alias("key"), brand.alias("brand")).where("key <> ''").distinct()
    rows = scratch.keep(rows.withColumn("words", F.split("key", " ")), "rows")
    base = rows.where((F.length(F.replace("key", F.lit(" "))) >= least_chars) & ~F.col("key").isin(list(dropped))) if dropped else rows.where(F.length(F.replace("key", F.lit(" "))) >= least_chars)
    longest = rows.agg(F.max(F.array_max(F.transform("words", F.length)))).first()[0] or 1
    held = F.array_distinct(F.concat("words", _initials(F.col("words"), F.lit(longest))))
    keyed = scratch.keep(rows.select("key", "brand", "words", F.explode(held).alias("word")), "keyed")
    often = keyed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asks = base.select("key", "brand", "words", F.explode("words").alias("word")).join(often, "word")
    asks = scratch.keep(asks.groupBy("key", "brand", "words").agg(F.min_by("word", F.struct("n", "word")).alias("word")), "asks")
    a, b = keyed.alias("a"), asks.alias("b")
    fits = (F.length("b.key") < F.length("a.key")) & F.coalesce(F.col("a.brand") == F.col("b.brand"), F.lit(True))
    begins = F.startswith(F.col("a.key"), F.concat(F.col("b.key"), F.lit(" ")))
    more = F.size("a.words") > F.size("b.words")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & fits & more).where(begins | words_found(F.col("a.words"), F.col("b.words")))
    best = met.groupBy(F.col("a.key").alias("name"), F.col("a.brand").alias("brand")).agg(F.min_by(F.col("b.key"), F.struct(-F.length("b.key"), F.col("b.key"))).alias("base"))
    return best.select("name", "base") if brand_col is None else best.select("name", "brand", "base")
