"""Scan plans, the pages a scan reads, its checkpoints, and a replayed source that is resumed."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from brightloom.operators import scans as S
from brightloom.sources import replay
from brightloom.streaming import detect

NOW = "2026-03-10 12:00:00"
STATE = "source string, fingerprint string, known long, last_full_at timestamp_ntz, token int, token_fingerprint string, token_mode string, token_at timestamp_ntz"


def states(spark, *rows):
    table = spark.createDataFrame([tuple(str(x) if i in (3, 7) and x else x for i, x in enumerate(r)) for r in rows], STATE.replace("timestamp_ntz", "string"))
    return table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_full_at", "token_at")})


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_plans(spark):
    late, recent = "2026-02-01 00:00:00", "2026-03-09 12:00:00"
    rows = [
        ("never", "f", 0, None, None, None, None, None), ("known, never in full", "f", 5, None, None, None, None, None), ("due", "f", 5, late, None, None, None, None), ("recent", "f", 5, recent, None, None, None, None),
        ("nothing known", "f", 0, recent, None, None, None, None), ("open", "f", 5, recent, 7, "f", "incremental", recent), ("open in full", "f", 5, recent, 7, "f", None, recent),
        ("expired", "f", 5, recent, 7, "f", "full", "2026-03-09 11:59:59"), ("foreign", "f", 5, recent, 7, "g", "full", recent), ("no time", "f", 5, recent, 7, "f", "full", None),
    ]
    got = {r.source: (r.mode, r.first_page, r.scan_as, r.stop_after) for r in S.plan_scans(states(spark, *rows), now(), S.ScanRules(168, 24, 2)).collect()}
    anew, part = ("full", 0, "full", 0), ("incremental", 0, "incremental", 2)
    assert got == {
        "never": anew, "known, never in full": anew, "due": anew, "recent": part, "nothing known": anew, "open": ("resume", 7, "incremental", 2), "open in full": ("resume", 7, "full", 0),
        "expired": part, "foreign": part, "no time": part,
    }


def plain_scan(pages, first, stop, budget):
    """Pages read one by one; the last one's reason."""
    still, read = 0, []
    for at in sorted(p for p in pages if p >= first):
        read.append(at)
        still = 0 if pages[at] else still + 1
        if at == max(pages):
            return read, "end"
        if stop and still >= stop:
            return read, "unchanged"
        if budget and len(read) == budget:
            return read, "budget"
    return read, "end"


@pytest.mark.parametrize("budget", [None, 1, 3])
def test_pages_equal_a_scan_page_by_page(spark, budget):
    rng = random.Random(budget)
    rules = S.ScanRules(stop_after=2, page_budget=budget)
    plans, items, known, want = [], [], [], {}
    for n in range(30):
        source, pages = f"s{n}", {p: rng.random() < 0.4 for p in range(rng.randint(0, 9))}
        first, stop = rng.choice([0, 0, 2, 50]), rng.choice([0, 1, 2, 3])
        plans.append((source, first, stop))
        for p, news in pages.items():
            for k in range(3):
                key = f"{p}-{k}"
                kind = rng.choice(["new", "changed"]) if news and k == 1 else "same"
                items.append((source, p, key, "b"))
                if kind != "new":
                    known.append((source, key, "b" if kind == "same" else rng.choice(["a", None])))
        want[source] = plain_scan(pages, first, stop, budget)
    table = spark.createDataFrame(plans, "source string, first_page int, stop_after int")
    rows = S.with_kind(spark.createDataFrame(items, "source string, page int, id string, signature string"), spark.createDataFrame(known, "source string, id string, signature string"))
    got = {}
    for r in S.read_pages(table, rows, rules).orderBy("page").collect():
        got.setdefault(r.source, ([], []))
        got[r.source][0].append(r.page)
        got[r.source][1].append(r["last"])
    for source, (pages, why) in want.items():
        if pages:
            assert got[source][0] == pages and got[source][1][-1] == why and not any(got[source][1][:-1]), source
        else:
            assert source not in got


def test_a_scan_goes_on_from_the_checkpoint_that_it_left(spark):
    rules = S.ScanRules(stop_after=2, page_budget=2)
    items = spark.createDataFrame([("a", p, f"{p}", "x") for p in range(5)] + [("b", 0, "0", "x")], "source string, page int, id string, signature string")
    known = items.limit(0).select("source", "id", "signature")
    state = states(spark, ("a", "f", 0, None, None, None, None, None), ("b", "f", 0, None, None, None, None, None), ("c", "f", 0, None, None, None, None, None))
    seen = []
    for _ in range(3):
        plans = S.plan_scans(state, now(), rules)
        told = S.scan_results(plans, S.read_pages(plans, S.with_kind(items, known), rules), now()).orderBy("source").collect()
        seen.append([(r.source, r.mode, r.scan_as, r.first_page, r.pages, r.ended, r.token) for r in told])
        state = states(spark, *[(r.source, "f", 0, r.last_full_at, r.token, r.token_fingerprint, r.token_mode, r.token_at) for r in told])
    assert seen[0] == [("a", "full", "full", 0, 2, "budget", 2), ("b", "full", "full", 0, 1, "end", None), ("c", "full", "full", 0, 0, "end", None)]
    assert seen[1][0] == ("a", "resume", "full", 2, 2, "budget", 4) and seen[2][0] == ("a", "resume", "full", 4, 1, "end", None)
    assert told[0].last_full_at is not None and told[0].token_at is None


def scanned(spark, base, **options):
    replay.register(spark)
    stream = spark.readStream.format("brightloom_replay").options(**{k: str(v) for k, v in options.items()}).load()
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").start()
    query.processAllAvailable()
    query.stop()
    rows = [r.external_id for r in spark.read.schema(replay.SCHEMA).parquet(f"{base}/out").collect()] if (base / "out").exists() else []
    return sorted(int(r[5:]) for r in rows)


def test_replayed_scans(spark, tmp_path):
    common = {"size": 3, "advertiser": "x", "region": "7", "now": "2026-03-10T12:00:00", "ttl_hours": 24}
    assert scanned(spark, tmp_path / "full", pages=5, **common) == list(range(15))
    # Two pages in a row of known items end an incremental scan.
    assert scanned(spark, tmp_path / "part", pages=9, known_from=6, stop_after=2, **common) == list(range(12))
    own = replay.PageStream(common).fingerprint
    assert own != replay.PageStream({**common, "region": "8"}).fingerprint
    mark = lambda **x: json.dumps({"token": 3, "fingerprint": own, "at": "2026-03-10T00:00:00", "still": 0, **x})
    assert scanned(spark, tmp_path / "on", pages=5, checkpoint=mark(), **common) == list(range(9, 15))
    assert scanned(spark, tmp_path / "old", pages=5, checkpoint=mark(at="2026-03-09T11:00:00"), **common) == list(range(15))
    assert scanned(spark, tmp_path / "other", pages=5, checkpoint=mark(fingerprint="y"), **common) == list(range(15))
    # The stream's own checkpoint resumes where the last run ended.
    assert scanned(spark, tmp_path / "on", pages=7, **common) == list(range(9, 21))


def observed(spark, folder, rows):
    table = spark.createDataFrame(rows, "event_id long, user_id long, at string, what string")
    table.select("event_id", "user_id", F.col("at").cast("timestamp").alias("at"), "what").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("event_id long, user_id long, at timestamp, what string").parquet(str(folder))


def test_refresh_state_shrinks_when_resources_are_not_seen(spark, tmp_path):
    day = lambda d, h=0: f"2026-01-{d:02d} {h:02d}:00:00"
    batches = [
        [(1, 1, day(1), "a"), (2, 1, day(1, 5), "a"), (3, 2, day(1, 2), "x"), (4, 1, day(1, 6), "b"), (5, 3, day(1, 1), "q")],
        [(6, 1, day(2), "b"), (7, 2, day(2), None), (8, 2, day(1, 1), "z")],
        [(9, 4, day(9), "n"), (10, 2, day(8), "x")],
        [(11, 4, day(9, 1), "n"), (12, 3, day(9, 2), "q")],
    ]
    told, kept = {}, []
    for rows in batches:
        stream = observed(spark, tmp_path / "in", rows)
        got = detect.refresh_to_end(detect.refresh_stream(stream, ["user_id"], "at", F.col("what"), "3 DAYS"), spark, str(tmp_path / "run"))
        told = {r.event_id: r.kind for r in got.collect()}
        kept.append({r.key.user_id for r in spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "run/checkpoint")).collect()})
    assert told == {1: "new", 4: "refresh", 3: "new", 5: "new", 7: "refresh", 9: "new", 10: "new", 12: "new"}
    assert kept[0] == {1, 2, 3} and kept[-1] == {3, 4, 2}


class _Store:
    """A resource's state and timers, and what was asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_resource_has_one_timer_that_follows_its_last_sight():
    store, step = _Store(), detect._Refresh(100, ["user_id", "event_id", "kind"])
    step.init(store)
    sight = lambda n, at, what: SimpleNamespace(event_id=n, at_ms=at, content=what)
    clock = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    told = [tuple(r) for rows in ([sight(2, 5, "a"), sight(1, 0, "a")], [sight(3, 50, "b")], [sight(4, 50, "b")]) for r in step.handleInputRows((7,), iter(rows), clock(0))]
    assert told == [(7, 1, "new"), (7, 3, "refresh")]
    assert store.timers == [106] and store.calls == 6  # three looks, two changes, one timer
    list(step.handleExpiredTimer((7,), clock(120), None))
    assert store.value == ("b", 50) and store.timers == [106, 151]
    list(step.handleExpiredTimer((7,), clock(151), None))
    assert store.value is None
