"""Campaigns out of what items suggest: signals read from JSON, and candidates put together from items that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import text as X

BADGE_CONFIDENCE = 0.9
#: What a badge has that names a campaign, and how the partner is named in it.
CAMPAIGN_BADGE = r"\b(partner|sponsor|presented|official|anniversary|centennial|bicentennial|america 250)\b"
PARTNER = r"(?i)(?:proud\s+)?(?:official\s+)?(?:partner|sponsor)\s+(?:of|for|with)\s+(.+)"


def shown(name: Column) -> Column:
    """A name for people: blanks collapsed, without blanks and dashes at its ends."""
    return F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" -_"))


def signal_key(name: Column, brand: Column) -> Column:
    """What a campaign is known by: its words without the brand in front and without an article."""
    own, of = X.canonical_text(name), X.canonical_text(F.coalesce(brand, F.lit("")))
    bare = F.when((of != "") & F.startswith(own, F.concat(of, F.lit(" "))), F.substr(own, F.length(of) + 2)).otherwise(own)
    return F.regexp_replace(bare, "^(the|a|an) +", "")


def signals(items: DataFrame, id_col: str, brand_col: str, suggestions: Column, badges: Column, floor: float = 0.5) -> DataFrame:
    """``id, brand, key, name, confidence`` of every campaign that an item suggests.

    ``suggestions`` is JSON, a list of names or of objects with ``name`` and
    ``confidence`` (1 where it is missing, 0 where it is no number); ``badges``
    is a JSON object with a list of that name. JSON that can't be read suggests
    nothing. A badge counts where its key isn't suggested already, and once.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(brand_col).alias("brand"), suggestions.alias("s"), badges.alias("b"))
    each = rows.select("id", "brand", F.posexplode(F.from_json("s", "array<string>")).alias("place", "x"))
    whole = F.startswith("x", F.lit("{"))
    told = F.get_json_object("x", "$.confidence")
    confidence = F.when(whole & told.isNotNull(), F.coalesce(told.try_cast("double"), F.lit(0.0))).otherwise(F.lit(1.0))
    named = each.select("id", "brand", F.lit(0).alias("kind"), "place", F.trim(F.when(whole, F.get_json_object("x", "$.name")).otherwise(F.col("x"))).alias("name"), confidence.alias("confidence"))
    marks = rows.select("id", "brand", F.posexplode(F.from_json("b", "badges array<string>")["badges"]).alias("place", "x")).withColumn("x", shown(F.col("x")))
    marks = marks.where((F.col("x") != "") & F.regexp_like(X.canonical_text(F.col("x")), F.lit(CAMPAIGN_BADGE)))
    partner = shown(F.regexp_extract("x", PARTNER, 1))
    marked = marks.select("id", "brand", F.lit(1).alias("kind"), "place", F.when(partner != "", partner).otherwise(F.col("x")).alias("name"), F.lit(BADGE_CONFIDENCE).alias("confidence"))
    every = named.unionByName(marked).where((F.col("name") != "") & (F.col("confidence") >= floor))
    every = every.withColumn("key", signal_key(F.col("name"), F.col("brand"))).where("key <> ''")
    # Badges of a key that the item suggests, or that an earlier badge has, say nothing new.
    first = Window.partitionBy("id", "key").orderBy("kind", "place")
    kept = every.withColumn("nth", F.row_number().over(first)).where((F.col("kind") == 0) | (F.col("nth") == 1))
    return kept.select("id", "brand", "key", shown(F.col("name")).alias("name"), "confidence")


def most_common(rows: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """``keys, values``: the most frequent values of each group, the first by name of equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    top = counts.withColumn("nth", nth).where(F.col("nth") <= limit)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", value))).alias("x")).select(*keys, F.col(f"x.{value}").alias("values"))


def candidates(found: DataFrame, items: DataFrame, least: int = 2, products: int = 5) -> DataFrame:
    """``brand, key, name, theme, n, start, end, offer, products, items_mark`` of every campaign of ``least`` items.

    ``items(id, at, offer, product, assigned)``: items that a person assigned
    are not proposed. A campaign is called as most of its items call it, then by
    confidence, then by name, with the brand in front. Of campaigns of a brand
    with the same items, whose marks are equal, the first key is kept.
    """
    keys = ["brand", "key"]
    rows = found.join(items.where(~F.coalesce("assigned", F.lit(False))).drop("assigned"), "id")
    members = rows.groupBy(*keys, "id").agg(F.min("at").alias("at"))
    bits = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    groups = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.max("at").alias("end"), F.sum(bits).cast("decimal(38,0)").alias("items_mark")).where(F.col("n") >= least)
    groups = groups.withColumn("again", F.row_number().over(Window.partitionBy("brand", "n", "items_mark").orderBy("key"))).where("again = 1").drop("again")
    called = rows.groupBy(*keys, X.canonical_text(F.col("name")).alias("words")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 9).alias("sure"), F.min("name").alias("name"))
    called = called.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("a"), (-F.col("sure")).alias("b"), F.lower("name").alias("c"), "name")).alias("x")).select(*keys, F.col("x.name").alias("said"))
    once = rows.dropDuplicates([*keys, "id"])
    offers = most_common(once, keys, "offer", 1).select(*keys, F.col("values")[0].alias("offer"))
    goods = most_common(once, keys, "product", products).select(*keys, F.col("values").alias("products"))
    out = groups.join(called, keys).join(offers, keys, "left").join(goods, keys, "left")
    own, of = X.canonical_text(F.col("said")), X.canonical_text(F.col("brand"))
    branded = (own == of) | F.startswith(own, F.concat(of, F.lit(" ")))
    name = F.when(branded, F.col("said")).otherwise(F.trim(F.concat_ws(" ", "brand", "said")))
    theme = F.when(branded & (own != of), shown(F.substr("said", F.length("brand") + 1))).otherwise(F.col("said"))
    return out.select("brand", "key", name.alias("name"), theme.alias("theme"), "n", "start", "end", "offer", "products", "items_mark")
