"""Scans of paged sources: what each source is due for, what a scan reads, and what it leaves behind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEN = ("new", "changed", "unchanged")


@dataclass(frozen=True)
class ScanRules:
    """When a source is read in full again, how long a checkpoint holds, and when an incremental scan ends."""

    full_hours: float = 168
    ttl_hours: float = 24
    stop_after: int = 2
    page_budget: int | None = None


def fingerprint(source: Column, region: Column, page_size: Column) -> Column:
    """What a checkpoint's token is good for: another source, region or page size makes another one."""
    return F.substring(F.sha2(F.concat_ws("|", source.cast("string"), region.cast("string"), page_size.cast("string"), F.lit("newest-first")), 256), 1, 24)


def _within(at: Column, now: Column, hours: float) -> Column:
    """Whether ``at`` is known and no more than so many hours before ``now``."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp")) <= F.lit(round(hours * 3_600_000_000)), F.lit(False))


def plan_scans(sources: DataFrame, now: Column, rules: ScanRules = ScanRules()) -> DataFrame:
    """``sources`` with ``mode, first_page, scan_as, stop_after``.

    ``sources`` has ``source, fingerprint, known`` (how many items are known),
    ``last_full_at`` and a checkpoint's ``token, token_fingerprint, token_mode,
    token_at`` (null: none). A scan goes on from a checkpoint whose fingerprint
    is the source's own and that has not expired, in the mode that it was in.
    Otherwise it starts anew: in full when nothing is known or the last full
    scan is too long ago, else incrementally.
    """
    resume = F.col("token").isNotNull() & F.col("token_fingerprint").eqNullSafe(F.col("fingerprint")) & _within(F.col("token_at"), now, rules.ttl_hours)
    full = (F.coalesce("known", F.lit(0)) == 0) | F.col("last_full_at").isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_full_at").cast("timestamp")) >= F.lit(round(rules.full_hours * 3_600_000_000)))
    fresh = F.when(full, F.lit("full")).otherwise(F.lit("incremental"))
    planned = sources.select("*", F.when(resume, F.lit("resume")).otherwise(fresh).alias("mode"), F.when(resume, F.col("token")).otherwise(F.lit(0)).cast("int").alias("first_page"), F.when(resume, F.coalesce("token_mode", F.lit("full"))).otherwise(fresh).alias("scan_as"))
    return planned.withColumn("stop_after", F.when(F.col("scan_as") == "full", F.lit(0)).otherwise(F.lit(rules.stop_after)))


def with_kind(items: DataFrame, known: DataFrame) -> DataFrame:
    """``items(source, page, id, signature)`` with ``kind``: whether the id is known, and with which signature."""
    held = known.groupBy("source", "id").agg(F.max("signature").alias("held"), F.lit(True).alias("is_known"))
    rows = items.join(held, ["source", "id"], "left")
    same = F.col("held").eqNullSafe(F.col("signature"))
    return rows.withColumn("kind", F.when(F.col("is_known").isNull(), F.lit("new")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))).drop("held", "is_known")


def read_pages(plans: DataFrame, items: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """``source, page, new, changed, unchanged, last`` of the pages that each planned scan reads.

    Pages are read in order from the plan's first. A scan ends after as many
    pages in a row without news as the plan says (0: never), at the last page,
    or when the budget of pages is used up. ``items`` has its ``kind``; what
    goes through the windows is one row a page.
    """
    counted = items.groupBy("source", "page").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in SEEN])
    pages = counted.join(plans.select("source", "first_page", "stop_after"), "source").where(F.col("page") >= F.col("first_page"))
    order = Window.partitionBy("source").orderBy("page")
    news = (F.col("new") + F.col("changed") > 0).cast("int")
    # Pages without news since the last one with news.
    pages = pages.withColumn("island", F.sum(news).over(order)).withColumn("nth", F.row_number().over(order)).withColumn("final", F.lead("page").over(order).isNull())
    run = F.sum(1 - news).over(Window.partitionBy("source", "island").orderBy("page"))
    pages = pages.withColumn("enough", (F.col("stop_after") > 0) & (run >= F.col("stop_after")) & (news == 0))
    before = F.coalesce(F.max("enough").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    read = pages.withColumn("ended", before).where(~F.col("ended"))
    if rules.page_budget is not None:
        read = read.where(F.col("nth") <= rules.page_budget)
    why = F.when(F.col("final"), F.lit("end")).when(F.col("enough"), F.lit("unchanged")).when(F.lit(rules.page_budget is not None) & (F.col("nth") == F.lit(rules.page_budget or 0)), F.lit("budget"))
    return read.select("source", "page", *SEEN, why.alias("last"))


def scan_results(plans: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """One row a source: what was read, why the scan ended, and the state that the next plan starts from.

    A scan that used up its budget leaves a checkpoint at the page after its
    last. One that came to an end clears it, and counts as a full one if it was
    planned so or saw the last page. A source without pages has nothing to end.
    """
    done = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(k).alias(k) for k in SEEN], F.max("last").alias("ended"), F.max("page").alias("upto"))
    rows = plans.drop("known").join(done, "source", "left")
    open_ = F.col("ended") == "budget"
    finished = F.coalesce(F.col("ended").isin("end", "unchanged"), F.lit(True))
    whole = finished & ((F.col("scan_as") == "full") | (F.col("ended") == "end") | F.col("ended").isNull())
    return rows.select(
        "source", "mode", "scan_as", "first_page", F.coalesce("pages", F.lit(0)).alias("pages"), *[F.coalesce(k, F.lit(0)).alias(k) for k in SEEN], F.coalesce("ended", F.lit("end")).alias("ended"),
        F.when(open_, F.col("upto") + 1).cast("int").alias("token"), F.when(open_, F.col("fingerprint")).alias("token_fingerprint"), F.when(open_, F.col("scan_as")).alias("token_mode"), F.when(open_, now).alias("token_at"),
        F.when(finished, now).alias("last_success_at"), F.when(whole, now).otherwise(F.col("last_full_at")).alias("last_full_at"),
    )
