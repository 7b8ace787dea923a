"""Readers of the analytics side's inputs: taxonomies, transcripts, frames, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_NAME = r"frame_([0-9]+)_t([0-9]+)ms\.[A-Za-z0-9]+$"


def read_taxonomy(spark: SparkSession, path: str, tiers: int = 3) -> DataFrame:
    """A tab-separated taxonomy; rows without an id are left out.

    Columns of the file: Unique ID, Parent ID, Name, Tier 1 .. Tier n.
    """
    names = ["Unique ID", "Parent ID", "Name", *[f"Tier {i}" for i in range(1, tiers + 1)]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    clean = [F.nullif(F.trim(F.regexp_replace(f"`{n}`", "^﻿", "")), F.lit("")) for n in names]
    out = rows.select(*[c.alias(n.lower().replace(" ", "_")) for c, n in zip(clean, names)])
    path_ = F.array_join(F.array_compact(F.array(*[f"tier_{i}" for i in range(1, tiers + 1)])), " > ")
    return out.where(F.col("unique_id").isNotNull()).withColumn("full_path", path_)


_SEGMENT = "struct<start:double,end:double,start_ms:long,end_ms:long,text:string,offsets:struct<`from`:long,`to`:long>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``file, start_ms, end_ms, text`` of transcripts in three shapes.

    A list of segments in milliseconds, ``segments`` in seconds, or
    ``transcription`` with offsets. Anything else stops the read.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    shapes = (F.from_json("value", f"array<{_SEGMENT}>"), F.from_json("value", f"struct<segments:array<{_SEGMENT}>>")["segments"], F.from_json("value", f"struct<transcription:array<{_SEGMENT}>>")["transcription"])
    # An object read as a list is one segment without a text, so segments decide, not nulls.
    known = [F.filter(x, lambda s: s["text"].isNotNull() & F.coalesce(s["start_ms"].cast("double"), s["start"], s["offsets"]["from"].cast("double")).isNotNull()) for x in shapes]
    found = F.coalesce(*[F.when(F.size(k) > 0, k) for k in known])
    rows = files.select("file", F.coalesce(found, F.raise_error(F.lit("no transcript in a known shape")).cast(f"array<{_SEGMENT}>")).alias("found"))
    s = rows.select("file", F.inline("found"))
    start = F.coalesce("start_ms", F.round(F.col("start") * 1000).cast("long"), "offsets.from")
    end = F.coalesce("end_ms", F.round(F.col("end") * 1000).cast("long"), "offsets.to")
    return s.select("file", start.alias("start_ms"), end.alias("end_ms"), F.trim("text").alias("text"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``path, frame_index, time_ms, length`` of a folder of frames named ``frame_N_tMms``."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    found = rows.select("path", "length", F.regexp_extract("path", FRAME_NAME, 1).try_cast("long").alias("frame_index"), F.regexp_extract("path", FRAME_NAME, 2).try_cast("long").alias("time_ms"))
    return found.where(F.col("frame_index").isNotNull())


def duplicate_frames(frames: DataFrame) -> DataFrame:
    """Indices or times that more than one frame has."""
    by = [frames.groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1") for c in ("frame_index", "time_ms")]
    return by[0].unionByName(by[1])


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS 2.0 and Atom documents in ``feeds(source_id, xml)``, with expressions alone.

    A name space on the root is dropped first; XPath names are local.
    """
    bare = F.regexp_replace("xml", r'\sxmlns(:[a-z]+)?="[^"]*"', "")
    x = feeds.select("source_id", bare.alias("x"))
    shapes = []
    for item, link, when, key in (("/rss/channel/item", "link/text()", "pubDate/text()", "guid/text()"), ("/feed/entry", "link/@href", "published/text()", "id/text()")):
        columns = [F.xpath("x", F.lit(f"{item}/{part}")).alias(name) for name, part in (("title", "title/text()"), ("url", link), ("published", when), ("external_id", key))]
        shapes.append(x.select("source_id", F.explode(F.arrays_zip(*columns)).alias("i")).select("source_id", "i.*"))
    rows = shapes[0].unionByName(shapes[1])
    text = F.regexp_replace("published", "^[A-Z][a-z]{2}, ", "")
    times = F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(text))
    return rows.select("source_id", "external_id", "title", "url", times.alias("published_at"))


def watermarks(items: DataFrame, state: DataFrame) -> DataFrame:
    """``source_id, watermark``: the latest published time, or the one known before."""
    seen = items.groupBy("source_id").agg(F.max("published_at").alias("seen"))
    return state.join(seen, "source_id", "full").select("source_id", F.coalesce("seen", "watermark").alias("watermark"))


def iso_duration_ms(x) -> F.Column:
    """Milliseconds of an ISO 8601 duration such as ``P1DT2H3M4.5S``.

    Null for anything else, and for years and months, which have no fixed length.
    """
    number = lambda unit, zone: F.coalesce(F.regexp_extract(F.regexp_extract(x, zone, 0), f"([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    day, time = "^P[^T]*", "T.*$"
    seconds = number("W", day) * 604_800 + number("D", day) * 86_400 + number("H", time) * 3600 + number("M", time) * 60 + number("S", time)
    form = r"^P(?=[0-9T])(?:[0-9]+W)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?$"
    return F.when(F.regexp_like(x, F.lit(form)), F.round(seconds * 1000).cast("long"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``rule_id, kind, pattern, label, severity`` of rule files: YAML lists where a YAML reader is installed, else JSON lists.

    Rules are configuration: a file is small and is read whole. A rule without
    a pattern, or of an unknown kind, stops the read.
    """
    schema = "array<struct<rule_id:string,kind:string,pattern:string,label:string,severity:string>>"
    files = spark.read.option("wholetext", True).text(path)
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        import json

        texts = [json.dumps(yaml.safe_load(r.value)) for r in files.collect()]  # configuration
        files = spark.createDataFrame([(t,) for t in texts], "value string")
    rules = files.select(F.inline(F.coalesce(F.from_json("value", schema), F.raise_error(F.lit("no list of rules")).cast(schema))))
    known = F.col("pattern").isNotNull() & F.col("kind").isin("keyword", "regex")
    checked = F.when(known, F.col("pattern")).otherwise(F.raise_error(F.concat(F.lit("a rule without a pattern or of an unknown kind: "), F.coalesce("rule_id", F.lit("?")))))
    return rules.select("rule_id", "kind", checked.alias("pattern"), "label", F.coalesce("severity", F.lit("medium")).alias("severity"))


def apply_rules(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, rule_id, label, severity`` of every rule that a text meets; keywords in any case."""
    low = F.lower(F.col(text_col))
    hit = F.when(F.col("kind") == "keyword", F.contains(low, F.lower("pattern"))).otherwise(F.expr(f"`{text_col}` RLIKE pattern"))
    return docs.select(id_col, text_col).join(F.broadcast(rules), hit).select(id_col, "rule_id", "label", "severity")  # rules are configuration
