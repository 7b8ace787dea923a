"""Events as items of polled sources: detection, scoring, change feeds, digests, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.functions import scoring as S
from brightloom.operators import polls as P
from brightloom.operators import scans
from brightloom.queries.registry import Registry, table
from brightloom.streaming import detect

registry = Registry()
NOW = "2024-01-30"
_ACT = "act AS (SELECT user_id, make_timestamp(floor(quantile_cont(epoch_us(ts), 0.25))::BIGINT) AS activated_at FROM events GROUP BY 1)"
_LIVE = f"CASE WHEN ts > activated_at AND ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY THEN 'live' ELSE 'backfill' END"


@registry.query(f"WITH {_ACT} SELECT event_id, user_id, {_LIVE} AS status FROM events JOIN act USING (user_id)")
def detect_live_backfill(spark, sf_dir):
    """Items as live or backfill by activation and look-back."""
    rows = P.with_activation(table(spark, sf_dir, "events"), "user_id", "ts")
    live = P.is_live(F.col("ts"), F.col("activated_at"), F.lit(NOW).cast("timestamp_ntz"), 20)
    return rows.select("event_id", "user_id", F.when(live, F.lit("live")).otherwise(F.lit("backfill")).alias("status"))


@registry.query(f"WITH {_ACT} SELECT event_id, user_id, {_LIVE} AS status FROM events JOIN act USING (user_id)")
def stream_detect(spark, sf_dir):
    """The same as a stream, ids counted once."""
    events = table(spark, sf_dir, "events")
    activated = P.with_activation(events, "user_id", "ts").groupBy("user_id").agg(F.first("activated_at").alias("activated_at"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    return detect.run_to_end(detect.live_stream(stream, activated, NOW, 20), spark)


def _folder(sf_dir: str) -> str:
    # A stream reads a folder; the glob picks the one table.
    return f"{sf_dir}/events*"


_SIGNAL = """p AS (SELECT event_id, user_id, event_type, ts, value, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
    s AS (SELECT *, CASE WHEN value * 3 > 180 THEN least(CASE WHEN event_type = 'view' THEN 0.5 ELSE 0.0 END, 0.25) ELSE least(CASE WHEN event_type = 'view' THEN 0.5 ELSE 0.0 END + CASE WHEN value * 3 <= 95 THEN 0.5 ELSE 0.2 END, 1.0) END AS likely FROM p),
    c AS (SELECT *, least(greatest(CASE user_id % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.45 ELSE 0.3 END + 0.15 * likely + least(0.2 * before, 0.4), 0.0), 1.0) AS confidence FROM s)"""


def _signals(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.withColumn("before", P.prior_count(events, ["user_id", "event_type"], ["ts", "event_id"]))
    likely = S.likelihood(F.col("event_type") == "view", F.col("value") * 3)
    tier = F.when(F.col("user_id") % 3 == 0, 0.6).when(F.col("user_id") % 3 == 1, 0.45).otherwise(0.3)
    return rows.withColumn("likely", likely).withColumn("confidence", S.signal_confidence(tier, F.col("likely"), F.col("before")))


@registry.query(f"WITH {_SIGNAL} SELECT event_id, before, round(likely, 6) AS likely, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'corroborated' ELSE 'single' END AS status FROM c")
def signal_scoring(spark, sf_dir):
    """Likelihood, corroboration and confidence of every signal."""
    return _signals(spark, sf_dir).select("event_id", "before", F.round("likely", 6).alias("likely"), F.round("confidence", 6).alias("confidence"), F.when(F.col("confidence") >= 0.7, F.lit("corroborated")).otherwise(F.lit("single")).alias("status"))


@registry.query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events")
def running_corroboration(spark, sf_dir):
    """How many signals of its group came before each."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", P.prior_count(events, ["user_id", "event_type"], ["ts", "event_id"]).alias("before"))


@registry.query("SELECT user_id, isoyear(ts) || '-w' || lpad(week(ts)::VARCHAR, 2, '0') AS bucket, count(*) AS n, max(ts) AS last_activity FROM events GROUP BY 1, 2")
def campaign_group_week(spark, sf_dir):
    """Groups of a source's items by ISO week."""
    return table(spark, sf_dir, "events").groupBy("user_id", S.iso_week_key(F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_activity"))


@registry.query(f"""WITH {_SIGNAL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY confidence DESC, event_id) AS n FROM c)
    SELECT user_id, event_type, count(*) AS signals, min(event_id) FILTER (n = 1) AS headline, string_agg(event_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS top_ids FROM r GROUP BY 1, 2""")
def digest(spark, sf_dir):
    """Groups of signals with their headline and five best."""
    rows = _signals(spark, sf_dir)
    keys = ["user_id", "event_type"]
    # The five best are told before anything is collected, and on the map side first.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "event_id"))
    top = rows.select(*keys, "event_id", nth.alias("n")).where("n <= 5").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "event_id"))).alias("best"))
    d = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals")).join(top, keys)
    return d.select("user_id", "event_type", "signals", F.col("best")[0]["event_id"].alias("headline"), F.array_join(F.transform("best", lambda b: b["event_id"].cast("string")), ",").alias("top_ids"))


_CDC = """l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
    SELECT user_id, event_id, CASE WHEN last IS NULL THEN 'created' ELSE 'updated' END AS change_type FROM l WHERE last IS DISTINCT FROM event_type"""


@registry.query(f"WITH {_CDC}")
def cdc_changes(spark, sf_dir):
    """A change feed from snapshots: created first, updated where the hash changes."""
    return P.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "change_type")


@registry.query(f"WITH {_CDC}")
def stream_cdc(spark, sf_dir):
    """The same feed from a stream with state for each key."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(_folder(sf_dir))
    return detect.run_to_end(detect.change_stream(stream), spark)


@registry.query("""
    SELECT user_id, event_id AS latest, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def source_latest_run(spark, sf_dir):
    """The latest run of every source."""
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_id").alias("latest"), F.col("b.ts").alias("ts"), F.col("b.event_type").alias("event_type"))


@registry.query("""
    SELECT user_id % 5 AS provider, max(ts) AS cooldown_until, max(CASE WHEN event_type = 'error' THEN ts END) >= TIMESTAMP '2024-01-29' AS open FROM events GROUP BY 1""")
def provider_circuit(spark, sf_dir):
    """Whether a provider's latest error keeps its circuit open."""
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("provider"))
    return g.agg(F.max("ts").alias("cooldown_until"), (F.max(F.when(F.col("event_type") == "error", F.col("ts"))) >= F.lit("2024-01-29").cast("timestamp_ntz")).alias("open"))


@registry.query("""
    WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT user_id, errors, least(6.0 * 2.0 ** least(errors, 8), 168.0) AS hours FROM e""")
def backoff_schedule(spark, sf_dir):
    """Hours to the next poll after errors."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.select("user_id", "errors", S.backoff_hours(F.lit(6.0), F.col("errors")).alias("hours"))


FORGET = "36 HOURS"
_REFRESH = f"""l AS (SELECT user_id, event_type, event_id, ts, floor(value / 40)::BIGINT AS level, lag(floor(value / 40)::BIGINT) OVER w AS last, lag(ts) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type, event_id, CASE WHEN seen IS NULL OR ts - seen > INTERVAL {FORGET} THEN 'new' ELSE 'refresh' END AS kind FROM l WHERE seen IS NULL OR ts - seen > INTERVAL {FORGET} OR last IS DISTINCT FROM level"""


@registry.query(f"WITH {_REFRESH}")
def refresh_feed(spark, sf_dir):
    """Kinds of activity of each user as resources: new when not seen for a day and a half, refreshed where the level of the value differs."""
    rows = P.refreshes(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", F.floor(F.col("value") / 40), FORGET)
    return rows.select("user_id", "event_type", "event_id", "kind")


@registry.query(f"WITH {_REFRESH}")
def stream_refresh(spark, sf_dir):
    """The same from a stream whose state forgets what was not seen for that long."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(_folder(sf_dir))
    return detect.refresh_to_end(detect.refresh_stream(stream, ["user_id", "event_type"], "ts", F.floor(F.col("value") / 40), FORGET), spark)


SCAN_AT, SCAN_PAGE = "2024-01-25", 4
RULES = scans.ScanRules(full_hours=24 * 4, ttl_hours=36, stop_after=2, page_budget=6)
_SCANS = f"""
    e AS (SELECT user_id AS source, event_id AS id, event_type || '|' || value::VARCHAR AS signature, event_type, value, ts FROM events),
    items AS (SELECT source, id, signature, (row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) - 1) // {SCAN_PAGE} AS page FROM e),
    known AS (SELECT source, id, CASE WHEN event_type = 'error' AND value > 100 THEN NULL ELSE signature END AS signature FROM e WHERE ts < TIMESTAMP '{SCAN_AT}'),
    fp AS (SELECT DISTINCT source, substr(sha256(source || '|' || source % 4 || '|{SCAN_PAGE}|newest-first'), 1, 24) AS fingerprint, substr(sha256(source || '|' || (source % 4 + CASE WHEN source % 5 = 0 THEN 1 ELSE 0 END) || '|{SCAN_PAGE}|newest-first'), 1, 24) AS token_fingerprint FROM e),
    state AS (SELECT fp.*, (SELECT count(*) FROM known k WHERE k.source = fp.source) AS known, max(ts) FILTER (event_type = 'purchase') AS last_full_at, max(ts) FILTER (event_type = 'click') AS token_at, arg_max(id % 4, ts) FILTER (event_type = 'click') AS token
              FROM fp JOIN e USING (source) WHERE ts < TIMESTAMP '{SCAN_AT}' GROUP BY ALL),
    plans AS (SELECT *, CASE WHEN resume THEN 'resume' WHEN whole THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN resume THEN token ELSE 0 END::INTEGER AS first_page, CASE WHEN resume OR NOT whole THEN 'incremental' ELSE 'full' END AS scan_as FROM
        (SELECT *, coalesce(token_fingerprint = fingerprint AND TIMESTAMP '{SCAN_AT}' - token_at <= INTERVAL 36 HOURS, false) AS resume, coalesce(known = 0 OR TIMESTAMP '{SCAN_AT}' - last_full_at >= INTERVAL 96 HOURS, true) AS whole FROM state))"""


def _scan_plans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), "event_type", "value", "ts")
    e = e.withColumn("signature", F.concat_ws("|", "event_type", F.col("value").cast("string")))
    before = e.where(F.col("ts") < F.lit(SCAN_AT).cast("timestamp_ntz"))
    known = before.select("source", "id", F.when(~((F.col("event_type") == "error") & (F.col("value") > 100)), F.col("signature")).alias("signature"))
    click, region = F.when(F.col("event_type") == "click", F.struct("ts", (F.col("id") % 4).alias("token"))), F.col("source") % 4
    state = before.groupBy("source").agg(F.count(F.lit(1)).alias("known"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_full_at"), F.max(click).alias("c"))
    mark = lambda moved: scans.fingerprint(F.col("source"), region + moved, F.lit(SCAN_PAGE))
    state = state.select("source", "known", "last_full_at", F.col("c.ts").alias("token_at"), F.col("c.token").alias("token"), F.lit("incremental").alias("token_mode"), mark(F.lit(0)).alias("fingerprint"), mark(F.when(F.col("source") % 5 == 0, 1).otherwise(0)).alias("token_fingerprint"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("id")))
    items = e.select("source", "id", "signature", F.floor((place - 1) / SCAN_PAGE).alias("page"))
    return scans.plan_scans(state, F.lit(SCAN_AT).cast("timestamp_ntz"), RULES), items, known


@registry.query(f"WITH {_SCANS} SELECT source, mode, first_page, scan_as, CASE WHEN scan_as = 'full' THEN 0 ELSE 2 END AS stop_after FROM plans")
def scan_plans(spark, sf_dir):
    """What each source is due for: resumed from a valid checkpoint, in full, or incrementally."""
    return _scan_plans(spark, sf_dir)[0].select("source", "mode", "first_page", "scan_as", "stop_after")


@registry.query(f"""WITH RECURSIVE {_SCANS},
    kinds AS (SELECT i.source, page, count(*) FILTER (k.id IS NULL) AS "new", count(*) FILTER (k.id IS NOT NULL AND k.signature IS DISTINCT FROM i.signature) AS changed, count(*) FILTER (k.id IS NOT NULL AND k.signature IS NOT DISTINCT FROM i.signature) AS unchanged
              FROM items i LEFT JOIN known k ON k.source = i.source AND k.id = i.id GROUP BY 1, 2),
    final AS (SELECT source, max(page) AS page FROM kinds GROUP BY 1),
    steps AS (SELECT p.source, p.scan_as, k.page, k."new", k.changed, k.unchanged, CASE WHEN k."new" + k.changed = 0 THEN 1 ELSE 0 END AS still, 1 AS nth FROM plans p JOIN kinds k ON k.source = p.source AND k.page = p.first_page
        UNION ALL SELECT s.source, s.scan_as, k.page, k."new", k.changed, k.unchanged, CASE WHEN k."new" + k.changed = 0 THEN s.still + 1 ELSE 0 END, s.nth + 1 FROM steps s JOIN kinds k ON k.source = s.source AND k.page = s.page + 1 WHERE (s.scan_as = 'full' OR s.still < 2) AND s.nth < 6),
    done AS (SELECT source, count(*) AS pages, sum("new")::BIGINT AS "new", sum(changed)::BIGINT AS changed, sum(unchanged)::BIGINT AS unchanged, max(page) AS upto, arg_max(still, page) AS still FROM steps GROUP BY 1),
    told AS (SELECT plans.*, pages, "new", changed, unchanged, upto, CASE WHEN pages IS NULL OR upto = final.page THEN 'end' WHEN scan_as <> 'full' AND still >= 2 THEN 'unchanged' ELSE 'budget' END AS ended FROM plans LEFT JOIN done USING (source) LEFT JOIN final USING (source))
    SELECT source, mode, scan_as, first_page, coalesce(pages, 0) AS pages, coalesce("new", 0) AS "new", coalesce(changed, 0) AS changed, coalesce(unchanged, 0) AS unchanged, ended, CASE WHEN ended = 'budget' THEN upto + 1 END::INTEGER AS token,
           CASE WHEN ended = 'budget' THEN fingerprint END AS token_fingerprint, CASE WHEN ended = 'budget' THEN scan_as END AS token_mode, CASE WHEN ended = 'budget' THEN TIMESTAMP '{SCAN_AT}' END AS token_at,
           CASE WHEN ended <> 'budget' THEN TIMESTAMP '{SCAN_AT}' END AS last_success_at, CASE WHEN ended = 'end' OR (ended <> 'budget' AND scan_as = 'full') THEN TIMESTAMP '{SCAN_AT}' ELSE last_full_at END AS last_full_at FROM told""")
def scan_results(spark, sf_dir):
    """What each planned scan reads until it ends, and the state it leaves."""
    plans, items, known = _scan_plans(spark, sf_dir)
    pages = scans.read_pages(plans, scans.with_kind(items, known), RULES)
    return scans.scan_results(plans, pages, F.lit(SCAN_AT).cast("timestamp_ntz"))
