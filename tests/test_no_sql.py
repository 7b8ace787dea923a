"""Queries that SQL cannot express, against plain Python over whole tables."""

import html as H
import re
from difflib import SequenceMatcher

import numpy as np

from brightloom import catalog
from brightloom.streaming import detect

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def shown(source):
    """A page's visible text, tag by tag."""
    s = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|title)\b.*?</\1\s*>", "<>", source)
    return " ".join(H.unescape(re.sub(r"(?s)<[^>]*>", " ", s)).split())


def test_html_text_links(spark):
    pages = {r.page_id: r.html for r in rows_of(spark, "pages")}
    got = run(spark, "html_text_links")
    assert len(got) == len(pages)
    for r in got:
        source = pages[r.page_id] or ""
        assert r.links == [H.unescape(x) for x in re.findall(r'(?i)<a\b[^>]*?\bhref="([^"]+)"', source)]
        assert r.title == H.unescape((re.findall(r"(?is)<title>(.*?)</title>", source) or [""])[0]).strip()
        assert r.text.split() == shown(source).split()


def test_frame_retention(spark):
    frames = {}
    for r in rows_of(spark, "embeddings"):
        bits = 0
        for x in r.embedding[:32]:
            bits = bits * 2 + (x > 0)
        frames.setdefault(r.vec_id // 8, {})[r.vec_id % 8] = bits
    want = set()
    for item, of in frames.items():
        last = None
        for frame in sorted(of):
            kept = last is None or bin(of[frame] ^ last).count("1") >= 14
            last = of[frame] if kept else last
            want.add((item, frame, kept))
    assert {(r["item"], r.frame, r.kept) for r in run(spark, "frame_retention")} == want


def test_evidence_frame_select(spark):
    times = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "unix_micros(CAST(ts AS timestamp)) AS at").collect():
        times.setdefault(r.user_id, []).append(r["at"])
    got = {}
    for r in run(spark, "evidence_frame_select"):
        got.setdefault(r.user_id, []).append(r["at"])
    assert set(got) == set(times)
    for user, all_ in times.items():
        all_.sort()
        chosen = list(all_)
        if len(all_) > 5:
            chosen = [all_[0], all_[-1]]
            while len(chosen) < 5:
                chosen.append(max(all_, key=lambda t: min(abs(t - c) for c in chosen)))
        assert sorted(got[user]) == sorted(chosen)


def test_evidence_by_priority(spark):
    users = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "event_type", "value", "props", "unix_micros(CAST(ts AS timestamp)) AS at").collect():
        users.setdefault(r.user_id, []).append(r)
    got = {}
    for r in run(spark, "evidence_by_priority"):
        got.setdefault(r.user_id, {})[r.event_id] = r.reason
    for user, rows in users.items():
        rows.sort(key=lambda r: r.event_id)
        chosen = {rows[0].event_id: "ends", rows[-1].event_id: "ends"}
        grave = sorted((0 if r.value > 120 else 1, r.event_id) for r in rows if r.event_type == "error" and r.value > 60)
        long = sorted((-len(r.props), r.event_id) for r in rows if r.event_type == "purchase" and r.value > 120)
        for reason, of in (("severity", grave), ("density", long)):
            for _, key in of:
                if len(chosen) < 12:
                    chosen.setdefault(key, reason)
        while len(chosen) < min(12, len(rows)):
            have = [r["at"] for r in rows if r.event_id in chosen]
            rest = [r for r in rows if r.event_id not in chosen]
            chosen[max(rest, key=lambda r: (min(abs(r["at"] - t) for t in have), -r.event_id)).event_id] = "spread"
        assert got[user] == chosen


def test_avg_linkage_clusters(spark):
    groups = {}
    for r in rows_of(spark, "embeddings"):
        v = np.array(r.embedding, float)
        groups.setdefault(r.label, []).append((r.vec_id, v / np.linalg.norm(v)))
    got = {(r.label, r.vec_id): r.cluster for r in run(spark, "avg_linkage_clusters")}
    for label, members in groups.items():
        clusters = [[m] for m in sorted(members, key=lambda m: m[0])]
        while len(clusters) > 1:
            pairs = [(np.mean([a @ b for _, a in x for _, b in y]), -i, -j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j]
            best, i, j = max(pairs)
            if best < 0.1:
                break
            clusters[-i] += clusters.pop(-j)
        want = {frozenset(k for k, _ in c) for c in clusters if len(c) >= 3}
        found = {}
        for key, _ in members:
            found.setdefault(got[label, key], set()).add(key)
        assert {frozenset(v) for k, v in found.items() if k >= 0} == want


def test_embedding_pca3(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows_of(spark, "embeddings")}
    got = run(spark, "embedding_pca3")
    x = np.stack([vectors[r.vec_id] for r in got])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs([r.p for r in got]), np.abs(x @ axes[:3].T), atol=1e-6)


def test_approx_distinct(spark):
    lines = rows_of(spark, "lineitem")
    for r in run(spark, "approx_distinct"):
        mine = [x for x in lines if x.l_returnflag == r.l_returnflag]
        n = len({x.l_partkey for x in mine})
        assert abs(r.parts - n) <= 0.1 * n
        q = sorted(x.l_quantity for x in mine)
        assert q[(len(q) - 1) // 2] <= r.median <= q[len(q) // 2]


def test_post_text_dup_difflib(spark):
    docs, seen = [], set()
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id):  # the first of equal texts stands for all
        kind = (r.source, r.n_chars, r.text if re.search("[a-z0-9]", r.text.lower()) else "")
        docs += [r] if kind not in seen else []
        seen.add(kind)
    grams = {}
    for r in docs:
        w = re.findall("[a-z0-9]+", r.text.lower())
        grams[r.doc_id] = set(w) if len(w) <= 2 else set(zip(w, w[1:]))
    want = {}
    for a in docs:
        for b in docs:
            if a.source == b.source and a.doc_id < b.doc_id and abs(a.n_chars - b.n_chars) <= 20:
                x, y = grams[a.doc_id], grams[b.doc_id]
                j = len(x & y) / len(x | y) if x | y else 1.0
                if j >= 0.8:
                    ratio = 1.0 if a.text == b.text else SequenceMatcher(None, a.text.split(), b.text.split(), autojunk=False).ratio()
                    want[a.doc_id, b.doc_id] = round(max(j, ratio), 9)
    assert {(r.left, r.right): round(r.similarity, 9) for r in run(spark, "post_text_dup_difflib")} == want


def test_changes_over_batches_and_late_items(spark, tmp_path):
    day = lambda d: f"2026-01-{d:02d} 00:00:00"
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    first = [(1, day(3), 1, "a"), (2, day(4), 1, "a"), (3, day(5), 1, "b"), (4, day(1), 2, "x")]
    second = [(5, day(4), 1, "c"), (6, day(6), 1, "b"), (7, day(7), 1, "c"), (8, day(1), 2, "y")]
    for i, batch in enumerate((first, second)):
        spark.createDataFrame(batch, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = detect.change_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.event_id, r.change_type) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "created"), (3, "updated"), (4, "created"), (5, "late"), (7, "updated"), (8, "updated")}


def test_a_stream_that_forgets(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", 1), (1, "2026-01-01 00:00:00", 1), (2, "2026-01-02 00:00:00", 1)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id").write.parquet(f"{tmp_path}/in")
    activated = spark.createDataFrame([(1,)], "user_id long").selectExpr("user_id", "CAST('2026-01-01 12:00:00' AS timestamp_ntz) AS activated_at")
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").parquet(f"{tmp_path}/in")
    got = detect.run_to_end(detect.live_stream(stream, activated, "2026-01-03 00:00:00", forget_after="1 day"), spark).collect()
    assert {(r.event_id, r.status) for r in got} == {(1, "backfill"), (2, "live")} and len(got) == 2
