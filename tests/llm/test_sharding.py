import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brightloom.llm import sharding as M

SF = "/root/testdata/sf0.001"


def held(rows):
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def gapless(rows):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    return all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_places_every_row_and_sizes_are_near_equal(spark, sf):
    path = f"/root/testdata/{sf}"
    got = M.op13_sharding(spark, path)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.collect()
    want = Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    loads = held(rows)
    assert set(loads) == set(range(16)) and gapless(rows)
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 16
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert Counter(rows) == Counter(M.op13_sharding(spark, path).collect())


def plain_fold(entries, shards):
    """The rebalancing of (bytes, slot, part, shard) in plain Python."""
    room, loads, out = sum(e[0] for e in entries) / shards, [0] * shards, {}
    for size, slot, part, at in sorted(entries, key=lambda e: (-e[0], e[1], e[2])):
        to = at if at < shards and loads[at] + size <= room else loads.index(min(loads))
        loads[to] += size
        out[slot, part] = to
    return out


def test_rebalancing_equals_plain_fold_and_moves_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = M.slot_sizes(M.records(docs, slots=256), 256)
    first = M.first_map(sizes, 8).cache()
    entries = [(r.bytes, r.slot_no, r.part, r["shard"]) for r in first.collect()]
    balanced = M.rebalanced(first, 8).cache()
    got = {(r.slot_no, r.part): r["shard"] for r in balanced.collect()}
    assert got == plain_fold(entries, 8)
    again = {(r.slot_no, r.part): r["shard"] for r in M.rebalanced(balanced, 8).collect()}
    assert sum(again[k] != got[k] for k in got) <= len(got) / 8
    more = {(r.slot_no, r.part): (r["shard"], r.version, r.bytes) for r in M.grown(balanced, 8).collect()}
    assert {v[1] for v in more.values()} == {2}
    assert all(more[k][0] in (got[k], 8) for k in got)
    loads = Counter()
    for shard, _, size in more.values():
        loads[shard] += size
    assert 0.5 < loads[8] / (sum(loads.values()) / 9) < 1.5


def test_versions_are_stored_side_by_side(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "map")
    M.shard(docs, path, 4, 64).count()
    before, now = M.read_map(spark, path, 0), M.read_map(spark, path)
    assert [m.select("version").distinct().collect()[0][0] for m in (before, now)] == [0, 1]
    M.write_map(M.grown(now, 4), path)
    assert M.read_map(spark, path).select(F.max("version"), F.max("shard")).first() == (2, 4)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        M.write_map(now, path)


def test_a_hot_id_is_split(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("x y z")).alias("text"), F.lit(1).alias("slot"), F.lit("a").alias("shard"), F.lit(0).alias("size"))
    rows = M.shard(docs, str(tmp_path / "map")).collect()
    loads = held(rows)
    assert len(rows) == 3000 and gapless(rows) and max(loads.values()) - min(loads.values()) <= 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((None if i < 1000 else i, 1 if i % 2 else 6, 0 if i % 2 else zlib.crc32(b"x y z")) for i in range(3000))


def test_odd_tables(spark, tmp_path):
    rows = [(1, "é" * 200_000), (2, None), (2, None), (None, ""), (3, "a"), (3, "a"), (4, "\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.shard(docs, str(tmp_path / "map"), 3).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len((t or "").encode()) + 1) for k, t in rows) and gapless(got)
    assert sorted(held(got).values()) == [4, 5, 400_001]
    assert M.shard(docs.limit(0), str(tmp_path / "none")).collect() == []


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("own"))
    path = str(tmp_path / "map")
    placed = {r.doc_id: r["shard"] for r in M.shard(docs, path).collect()}
    M.write_shards(docs, M.read_map(spark, path), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.row.doc_id: r["shard"] for r in back.collect()} == placed
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, docs.collect()))


def test_native(spark):
    plan = M.op13_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
