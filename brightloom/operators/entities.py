"""What a model answers in JSON, as columns: brand, promotion, prices, offers and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import salvage
from brightloom.functions import text as X

#: The shape of an answer; what is missing is null.
ANSWER = """brand struct<name:string>, promotion string, prices array<struct<currency:string,amount:double>>, offers array<struct<value:string,type:string>>,
    financing struct<currency:string,monthly:double,months:int,apr:double>, evidence array<struct<text:string,reason:string,confidence:double>>"""
#: Signs of currencies.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "$": "$", "€": "€", "£": "£"}


def price_label(currency: Column, amount: Column) -> Column:
    """An amount as it is shown: the currency's sign, thousands marked, two digits; dollars where no currency is known."""
    code = F.upper(F.trim(F.coalesce(currency, F.lit("USD"))))
    sign = F.concat(code, F.lit(" "))
    for name, mark in SIGNS.items():
        sign = F.when(code == name, F.lit(mark)).otherwise(sign)
    return F.concat(sign, F.format_number(amount, 2))


def named(value: Column) -> Column:
    """A name with its blanks collapsed; null for nothing and for what stands for nothing."""
    return salvage.without_placeholder(F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("")))


def mapped(answers: DataFrame, id_col: str, answer_col: str, aliases: DataFrame) -> DataFrame:
    """``id, brand, promotion, prices, offers, evidence, confidence`` of each answer.

    The answer's first object is read, broken or not. A brand is written as
    ``aliases(name, brand)``, a short table of lower-case names, has it, and else with
    capitals. Prices of zero or less are none. An offer is its value, or its
    type where that is missing; financing with a monthly payment is an offer of
    its own. Evidence is what a text, or else a reason, says; ``confidence`` is
    the highest of it. An answer without an object has nulls and no entries.
    """
    rows = answers.select(F.col(id_col).alias("id"), F.from_json(salvage.salvaged_json(F.col(answer_col)), ANSWER).alias("a"))
    bare = F.nullif(F.trim(F.regexp_replace(F.regexp_replace("a.brand.name", "[®™©]", ""), r"\s+", " ")), F.lit(""))
    rows = rows.withColumn("bare", bare).join(F.broadcast(aliases.select(F.col("name").alias("alias"), F.col("brand").alias("known"))), F.lower("bare") == F.col("alias"), "left")  # a short table
    nothing = F.array().cast("array<string>")
    prices = F.transform(F.filter("a.prices", lambda p: p["amount"] > 0), lambda p: price_label(p["currency"], p["amount"]))
    offers = F.filter(F.transform("a.offers", lambda o: F.coalesce(F.nullif(F.trim(o["value"]), F.lit("")), o["type"])), lambda o: o.isNotNull())
    f = F.col("a.financing")
    months = F.when(f["months"] > 0, F.concat(f["months"].cast("string"), F.lit("-mo")))
    rate = F.when(f["apr"] > 0, F.concat(F.regexp_replace(F.format_number(f["apr"], 2), r"\.?0+$", ""), F.lit("% APR")))
    terms = F.concat_ws(" ", F.concat(price_label(f["currency"], f["monthly"]), F.lit("/mo")), months, rate)
    paid = F.when(f["monthly"].isNotNull(), F.array(terms)).otherwise(nothing)
    told = F.filter(F.transform("a.evidence", lambda e: F.coalesce(F.nullif(F.trim(e["text"]), F.lit("")), F.nullif(F.trim(e["reason"]), F.lit("")))), lambda e: e.isNotNull())
    return rows.select(
        F.col("id").alias(id_col), F.coalesce("known", X.brand_display(F.col("bare"))).alias("brand"), named(F.col("a.promotion")).alias("promotion"), F.coalesce(prices, nothing).alias("prices"),
        F.concat(F.coalesce(offers, nothing), paid).alias("offers"), F.coalesce(told, nothing).alias("evidence"), F.array_max(F.transform("a.evidence", lambda e: e["confidence"])).alias("confidence"),
    )
