"""Text expressions: normalisation, tokens, n-grams and set similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that a loose search reads as blanks.
LOOSE_MARKS = "_-/.,:;()[]"


def normalize_name(x: Column) -> Column:
    """Lower case, every run of other characters than ``a-z0-9`` as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def canonical_text(x: Column) -> Column:
    """As ``normalize_name``, with ``&`` read as "and"."""
    return normalize_name(F.replace(x, F.lit("&"), F.lit(" and ")))


def compact_key(x: Column) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def slug(x: Column, default: str = "campaign") -> Column:
    """Lower case with other runs as ``_``; a default for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(default))


def clean(x: Column) -> Column:
    """Trimmed text, null for nothing."""
    return F.nullif(F.trim(x), F.lit(""))


def strip_prefix_words(x: Column, prefix: Column) -> Column:
    """A name without its brand prefix and a leading article."""
    bare = F.when(F.startswith(x, F.concat(prefix, F.lit(" "))), F.substring(x, F.length(prefix) + 2, F.length(x))).otherwise(x)
    return F.regexp_replace(bare, "^(the|a|an) ", "")


def brand_display(x: Column) -> Column:
    """Without trade marks, blanks collapsed, all-lower words in title case."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(x, "[®™©]", ""), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w == F.lower(w), F.initcap(w)).otherwise(w)), " ")


def product_family(x: Column) -> Column:
    """A product's name without its model-year tokens."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(19|20)[0-9]{2}\b|'[0-9]{2}\b", " "), r"\s+", " "))


def tokens(x: Column) -> Column:
    """``[a-z0-9]+`` of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(0))


_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """What ``tokens`` finds, inside a task; none in a null."""
    return (text or "").lower().encode().translate(_WORD_BYTES).split()


def ngrams(words: Column, n: int = 2) -> Column:
    """Distinct n-grams, or the words themselves where there are no more than ``n``."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) <= n, words).otherwise(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; two empty sets are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def loose(x: Column) -> Column:
    """Text for whole-token search: marks as blanks, padded, lower case."""
    return F.concat(F.lit(" "), F.lower(F.translate(F.coalesce(x, F.lit("")), LOOSE_MARKS, " " * len(LOOSE_MARKS))), F.lit(" "))


def loose_match(columns: list[Column], terms: list[str]) -> Column:
    """Whether any column holds any term as whole tokens."""
    found = F.lit(False)
    for c in columns:
        for term in terms:
            found = found | F.contains(loose(c), F.lit(f" {term.lower()} "))
    return found


#: The pattern of an offer's values, and the words that mark its terms.
OFFER_VALUE = r"(?:\$\s*)?\d+(?:[,.]\d+)*(?:\.\d+)?\s*(?:%|percent|apr|mo|mos|month|months|day|days|yr|year|years)?"
OFFER_WORDS = [
    "apr", "allowance", "bonus", "cash", "discount", "due", "finance", "financing", "free", "lease", "lessee", "lessees",
    "month", "monthly", "months", "offer", "offers", "payment", "payments", "price", "save", "signing", "tax",
]


def commercial_terms(x: Column, words: Column) -> Column:
    """What an offer consists of: its values, its marking words, and those words with two neighbours on either side.

    ``words`` are the text's tokens, a column of their own: in a lambda they would be found anew for each member.
    """
    plain = F.lower(F.replace(x, F.lit("\n"), F.lit(" ")))
    values = F.transform(F.regexp_extract_all(plain, F.lit(f"({OFFER_VALUE})"), F.lit(0)), lambda v: F.concat(F.lit("value:"), F.regexp_replace(v, r"\s+", "")))
    places = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    marked = F.filter(places, lambda p: p["w"].isin(*OFFER_WORDS))
    terms = F.transform(marked, lambda p: F.concat(F.lit("term:"), p["w"]))
    start = lambda p: F.greatest(p["i"] - 2, F.lit(0))
    around = F.filter(F.transform(marked, lambda p: F.slice(words, start(p) + 1, p["i"] + 3 - start(p))), lambda c: F.size(c) >= 2)
    contexts = F.transform(around, lambda c: F.concat(F.lit("context:"), F.array_join(c, " ")))
    return F.array_distinct(F.concat(values, terms, contexts))
