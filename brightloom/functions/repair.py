"""Repair and reading of recognised text: run-together words, names, counts, terms of an offer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

#: How recognised text is put right, in this order: pattern, replacement, and whether case counts.
OCR_RULES = [
    ("％", "%", True),
    (r"\$([0-9]{1,3})\.([0-9]{3})(?![0-9])", r"\$$1,$2", True),
    (r"\bBELOWMSRP\b", "BELOW MSRP", False),
    (r"\bREBAT\b", "REBATE", False),
    (r"\bMILITARY&FIRSTRESPONDER\b", "MILITARY & FIRST RESPONDER", False),
    (r"\bFIRSTRESPONDER\b", "FIRST RESPONDER", False),
    (r"\bONSELECT\b", "ON SELECT", False),
    (r"\bOffersexclude\b", "Offers exclude", False),
    (r"\bAPRfinancing\b", "APR financing", False),
    (r"\bDUEAT\b", "DUE AT", False),
    (r"\bLEASEDETAILS\b", "LEASE DETAILS", False),
    (r"\bCALL(?=[0-9])", "CALL ", False),
    (r"\b([0-9]{1,3})MOS\b", "$1 MOS", False),
    (r"(?<=[a-z])\.(?=[A-Z0-9])", ". ", True),
    (r"(?<=[0-9])\.(?=[A-Z])", ". ", True),
    (r"\s+", " ", True),
]
#: Legal forms that are no part of a name.
LEGAL_FORMS = ["inc", "incorporated", "corp", "corporation", "company", "co", "llc", "ltd", "limited", "plc", "gmbh", "ag", "sa", "nv", "holdings", "group"]
#: What a call to action, a disclaimer and an expiry look like.
CALL_TO_ACTION = r"(?i)\b(?:call now|shop now|learn more|visit us|order today|sign up|apply now|see dealer)\b"
DISCLAIMER = r"(?i)\b(?:offers? exclude|not all buyers|well-qualified|subject to|see dealer|terms and conditions|expires)\b"
EXPIRY = r"(?i)\b(?:expires?|ends?|through|until) ([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"


Rule = tuple[str, str, bool]


def apply_rules(text: Column, rules: list[Rule]) -> Column:
    """A text under a table of replacements, one after the other."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0] if rule[2] else f"(?i){rule[0]}", rule[1]), rules, text)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A table of replacements from tab-separated ``pattern, replacement, case`` (``any`` or ``same``), in the file's order."""
    lines = spark.read.text(path, wholetext=True).first()  # a rule file, which a person wrote
    rows = [line.split("\t") for line in (lines.value if lines else "").splitlines() if line.strip() and not line.startswith("#")]
    return [(r[0], r[1] if len(r) > 1 else "", len(r) < 3 or r[2].strip() != "any") for r in rows]


def ocr_repaired(text: Column, rules: list[Rule] = OCR_RULES) -> Column:
    """Recognised text put right by a table of rules, and trimmed."""
    return F.trim(apply_rules(text, rules))


def entity_text(text: Column) -> Column:
    """Repaired text without blanks before marks and without marks at its ends."""
    return F.btrim(F.regexp_replace(ocr_repaired(text), r"\s+([!?.,;:])", "$1"), F.lit(" ,;:-"))


def profile_name(name: Column) -> Column:
    """A name in lower case without trade marks and legal forms, ``&`` as a word."""
    t = F.regexp_replace(name, "[™®©]", "")
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), "[^0-9A-Za-z]+", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:" + "|".join(LEGAL_FORMS) + r")\b\.?", " ")
    return F.lower(F.trim(F.regexp_replace(t, " +", " ")))


#: What a letter or word after a number multiplies it by.
MAGNITUDES = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "mm": 1_000_000, "million": 1_000_000}
MOST_RATINGS = 10_000_000


def rating_count(value: Column) -> Column:
    """The number of ratings in a text, ``1,234`` or ``1.2K`` or ``3 M``; null for none, or for more than ten million."""
    number = rf"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*({'|'.join(sorted(MAGNITUDES, key=len, reverse=True))})\b)?"
    digits = F.replace(F.regexp_extract(value, number, 1), F.lit(","))
    unit = F.lower(F.regexp_extract(value, number, 2))
    times = reduce(lambda c, m: c.when(unit == m[0], F.lit(m[1])), MAGNITUDES.items(), F.when(unit == "", F.lit(1)))
    n = F.floor(F.round(F.when(digits != "", digits).try_cast("decimal(28,6)") * times, 3)).cast("long")
    return F.when(n <= MOST_RATINGS, n)


def financing(text: Column) -> Column:
    """``apr, months, expiry, ctas, disclaimer`` of an offer's text."""
    apr = F.regexp_extract(text, r"(?i)([0-9]{1,2}(?:\.[0-9]{1,2})?)% ?APR", 1)
    months = F.regexp_extract(text, r"(?i)\b([0-9]{1,3}) ?(?:months?|mos?)\b", 1)
    expiry = F.regexp_extract(text, EXPIRY, 1)
    return F.struct(
        F.when(apr != "", apr.cast("double")).alias("apr"),
        F.when(months != "", months.cast("bigint")).alias("months"),
        F.when(expiry != "", expiry).alias("expiry"),
        F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CALL_TO_ACTION), F.lit(0)), F.lower)), "|").alias("ctas"),
        F.regexp_like(text, F.lit(DISCLAIMER)).alias("disclaimer"),
    )


#: Short words of a product's name that stay in capitals, and beginnings of names that were run together.
KEPT_CAPITALS = ["LE", "AWD", "FWD", "RWD", "PHEV", "EV"]
MERGED_MODELS = r"(?i)(?:AND|OR|MODELS?|SERIES)[A-Z]{3,}"


def _drop_lead(words: Column, lead: Column) -> Column:
    """Words without a number of words at the beginning, if those are what they begin with."""
    n = F.size(lead)
    same = F.transform(F.slice(words, 1, n), F.lower) == lead
    return F.when((n > 0) & (F.size(words) > n) & same, F.slice(words, n + 1, F.size(words))).otherwise(words)


def _written(word: Column) -> Column:
    """A shouted word with capitals at its parts' beginnings only."""
    parts = F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2)))))
    return F.when(F.upper(word).isin(KEPT_CAPITALS), F.upper(word)).otherwise(F.array_join(parts, "-"))


def repaired_products(rows: DataFrame, id_col: str, products: Column, brand: Column, makes: list[str]) -> DataFrame:
    """``id, products``: the names of each row's products, put right, each once, in their order.

    A garbled year (``20GX4``) and the brand go from the beginning; a plain year
    stays and the brand behind it goes. A name that is shouted after its year is
    written with capitals. Names of one letter and names that are run together
    with a joining word are dropped, and so are names of makes alone where the
    brand says them or another product of the row is specific: two words or
    more, one of them a number. Rows without a product left are not told.

    Texts and names are written as they stand repaired: a filter that is pushed
    down would repeat all repairs for each use of a name.
    """
    scratch = Scratch(rows.sparkSession, "products")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    said = rows.select(F.col(id_col).alias("id"), brand.alias("brand"), F.posexplode(products).alias("place", "said"))
    lead = F.filter(F.split(F.lower("brand"), " +"), lambda w: w != "")
    words = said.select("id", "brand", "place", lead.alias("lead"), F.split(entity_text(F.col("said")), " +").alias("w"))
    words = scratch.keep(words, "words")
    garbled = F.regexp_like(F.get("w", F.lit(0)), F.lit("^20[A-Za-z]{1,4}[0-9]{1,4}$")) & (F.size("w") > 1)
    words = words.withColumn("w", F.when(garbled, F.slice("w", 2, F.size("w"))).otherwise(F.col("w")))
    words = words.withColumn("w", _drop_lead(F.col("w"), F.col("lead")))
    # With a year in front, what follows it is the name.
    dated = F.regexp_like(F.get("w", F.lit(0)), F.lit("^20[0-9]{2}$")) & (F.size("w") > 1)
    words = words.withColumn("shouted", F.regexp_like(F.array_join("w", " "), F.lit(r"^[A-Z\s0-9/()-]+$"))).withColumn("dated", dated)
    name = F.when(F.col("dated"), _drop_lead(F.slice("w", 2, F.size("w")), F.col("lead"))).otherwise(F.col("w"))
    words = words.withColumn("name", name)
    told = F.when(F.col("dated") & F.col("shouted"), F.transform("name", _written)).otherwise(F.col("name"))
    full = F.btrim(F.array_join(F.when(F.col("dated"), F.concat(F.slice("w", 1, 1), told)).otherwise(told), " "), F.lit(" ,-"))
    named = scratch.keep(words.select("id", "brand", "place", full.alias("name")), "named").where((F.length("name") >= 2) & ~F.regexp_like("name", F.lit(MERGED_MODELS)))
    named = named.withColumn("key", key(F.col("name")))
    parts = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda p: p != "")
    named = named.withColumn("specific", (F.size(parts) > 1) & F.exists(parts, lambda p: F.regexp_like(p, F.lit("^[0-9]+$"))))
    own = Window.partitionBy("id")  # the products of one row
    bare = F.col("key").isin(makes) & (F.max("specific").over(own) | F.contains(key(F.col("brand")), F.col("key")))
    kept = named.withColumn("bare", bare).where(~F.col("bare"))
    once = kept.groupBy("id", "key").agg(F.min(F.struct("place", "name")).alias("x"))
    listed = once.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select(F.col("id").alias(id_col), F.col("x.name").alias("products"))
