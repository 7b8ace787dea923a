import json

import pytest
from pyspark.sql import functions as F

from brightloom.operators import merge
from brightloom.sources import readers, replay, sinks
from brightloom.sources.pages import page_text_links


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Unique ID\tParent ID\tName\tTier 1\tTier 2\tTier 3\n1\t\tAuto\tAuto\t\t\n2\t1\tSUV\tAuto\tSUV\t\n\t\tnone\t\t\t\n", encoding="utf-8")
    rows = {r.unique_id: r.full_path for r in readers.read_taxonomy(spark, str(tmp_path)).collect()}
    assert rows == {"1": "Auto", "2": "Auto > SUV"}


def test_transcripts_in_three_shapes(spark, tmp_path):
    shapes = [
        [{"start_ms": 4250, "end_ms": 9125, "text": " two for one "}],
        {"segments": [{"start": 4.25, "end": 9.125, "text": "two for one"}]},
        {"transcription": [{"offsets": {"from": 4250, "to": 9125}, "text": "two for one"}]},
    ]
    for i, s in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(json.dumps(s))
    rows = readers.read_transcripts(spark, str(tmp_path)).collect()
    assert {(r.start_ms, r.end_ms, r.text) for r in rows} == {(4250, 9125, "two for one")} and len(rows) == 3
    (tmp_path / "3.json").write_text('"just words"')
    with pytest.raises(Exception, match="known shape"):
        readers.read_transcripts(spark, str(tmp_path)).collect()


def test_frames(spark, tmp_path):
    for name in ("frame_17_t8040ms.png", "frame_18_t8560ms.png", "frame_18_t9080ms.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    frames = readers.read_frames(spark, str(tmp_path))
    assert frames.count() == 3
    assert [(r.field, r.value, r.n) for r in readers.duplicate_frames(frames).collect()] == [("frame_index", 18, 2)]


def test_feeds_and_watermarks(spark):
    rss = '<rss version="2.0"><channel><item><title>A</title><link>http://x/a</link><pubDate>Tue, 09 Jun 2026 10:00:00 +0000</pubDate><guid>a</guid></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://x/b"/><published>2026-06-10T00:00:00Z</published><id>b</id></entry></feed>'
    items = readers.feed_items(spark.createDataFrame([("r", rss), ("f", atom)], "source_id string, xml string"))
    got = {r.external_id: (r.title, r.url, str(r.published_at)) for r in items.collect()}
    assert got["a"][:2] == ("A", "http://x/a") and got["a"][2].startswith("2026-06-09")
    assert got["b"][:2] == ("B", "http://x/b") and got["b"][2].startswith("2026-06-10")
    state = spark.createDataFrame([("r", None), ("z", None)], "source_id string, watermark timestamp")
    assert {r.source_id: r.watermark is not None for r in readers.watermarks(items, state).collect()} == {"r": True, "f": True, "z": False}
    said = {"PT1H2M3S": 3_723_000, "P1DT2H": 93_600_000, "P2W": 1_209_600_000, "P1M": None, "P1Y2M": None, "PT0.5S": 500, "PT": None, "x": None}
    rows = spark.createDataFrame(list(said.items()), "said string, want long").select("want", readers.iso_duration_ms(F.col("said")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_pages(spark):
    html = '<html><title>T &amp; U</title><meta name="description" content="d"><script>var x="<p>no</p>"</script><p>Hello  <b>you</b></p><a href="/l">link</a></html>'
    row = page_text_links(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")).orderBy("page_id").first()
    assert (row.title, row.description, row.text, row.links) == ("T & U", "d", "Hello you link", ["/l"])


def test_replay_source_in_batch_and_as_stream(spark, tmp_path):
    replay.register(spark)
    batch = spark.read.format("brightloom_replay").option("pages", 2).option("size", 5).load()
    assert batch.count() == 10 and batch.select("external_id").distinct().count() == 10
    stream = spark.readStream.format("brightloom_replay").option("pages", 2).option("size", 5).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    for _ in range(60):
        q.processAllAvailable()
        if spark.read.schema(batch.schema).parquet(str(tmp_path / "o")).count() >= 10:
            break
    q.stop()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10


def test_sinks(spark, tmp_path):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    children = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id long, pos long, text string")
    bundles = {r.id: json.loads(r.bundle) for r in sinks.evidence_bundles(parents, children, "id", "pos").collect()}
    assert [i["text"] for i in bundles[1]["items"]] == ["x", "y"] and bundles[2]["items"] == []
    out = str(tmp_path / "p")
    sinks.replace_partitions(parents, out, "id")
    sinks.replace_partitions(spark.createDataFrame([(1, "c")], parents.schema), out, "id")
    assert {r.name for r in spark.read.parquet(out).collect()} == {"c", "b"}
    sinks.export_lines(parents, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_rules_from_a_file(spark, tmp_path):
    rules = [{"rule_id": "a", "kind": "keyword", "pattern": "Free", "label": "offer", "severity": "low"}, {"rule_id": "b", "kind": "regex", "pattern": "[0-9]{3}", "label": "number"}]
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    read = readers.read_rules(spark, str(tmp_path / "rules.json"))
    docs = spark.createDataFrame([(1, "it is FREE"), (2, "call 555"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in readers.apply_rules(docs, read).collect()} == {(1, "a", "offer", "low"), (2, "b", "number", "medium")}
    (tmp_path / "bad.json").write_text(json.dumps([{"rule_id": "c", "kind": "magic", "pattern": "x"}]))
    with pytest.raises(Exception, match="unknown kind"):
        readers.read_rules(spark, str(tmp_path / "bad.json")).collect()


def test_manifests_and_replaced_rows(spark, tmp_path):
    frames = spark.createDataFrame([(1, 500, 2, "b"), (1, 0, 1, "a")], "item long, time_ms long, frame_index long, path string")
    said = spark.createDataFrame([(1, 10, 20, "hi"), (2, 0, 5, "only words")], "item long, start_ms long, end_ms long, text string")
    sinks.write_manifests(frames, said, "item", str(tmp_path / "m"))
    got = {r["item"]: r for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert [f.path for f in got[1].frames] == ["a", "b"] and got[2].frames == [] and got[2].transcript[0].text == "only words"
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert {tuple(r) for r in merge.replace_rows(old, new, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
