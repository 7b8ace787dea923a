import random

import xxhash
from pyspark.sql import functions as F

from brightloom.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints():
    for t in ["", " \t\n", "One", "one TWO", "a b c d É é a b c", "x " * 70_000, "a\x0bb\x1cc d", "same same same same"]:
        assert S.fingerprint(t.encode()) == brute_fingerprint(t), t[:20]
    assert S.fingerprint(None) == 0


def test_every_pair_within_three_bits_is_linked(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        f = rng.getrandbits(64)
        fps.append(f)
        for far in (1, 2, 3, 3, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), far):
                g ^= 1 << b
            fps.append(g)
    f = rng.getrandbits(64)
    for _ in range(40):  # a chain
        f ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(f)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    scratch = S.Scratch(spark, "test")
    near = {(r.a, r.b) for r in S._near_links(table).collect()}
    stars = S.connected_components(spark.createDataFrame(list(near), "a long, b long"))
    comps = table.join(stars, table.fp == stars.node, "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    far = S.connected_components(S._far_links(comps, scratch))
    found = {r.fp: r.c for r in comps.join(far, comps.comp == far.node, "left").select("fp", F.coalesce("root", "comp").alias("c")).collect()}
    want = brute_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(found) == groups({signed(k): v for k, v in want.items()})


def test_masked_keys_cover_distance_three(spark):
    keys = spark.createDataFrame([(7,), (-1,)], "fp long").select("fp", F.size(F.array_distinct(S._masked(F.col("fp")))).alias("n")).collect()
    assert all(r.n > 120 for r in keys)


def test_nulls_repeats_empty_and_extra_columns(spark):
    docs = spark.createDataFrame(
        [(3, None, "a"), (2, "", "b"), (None, "one two three four", "c"), (5, "one two three four", "d"), (5, "one two three four", "e"), (None, "quite another text here", "f")],
        "doc_id long, text string, component_id string",
    )
    rows = S.near_groups(docs).collect()
    assert len(rows) == 6
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    kept = S.near_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id) == [(False, 2), (False, 5)] and len(kept) == 3
    assert kept[0].__fields__ == docs.columns
    assert S.near_groups(docs.limit(0)).collect() == [] and S.near_dedup(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {d.doc_id: brute_fingerprint(d.text or "") for d in docs}
    root = brute_components(sorted(set(fps.values())))
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    for r in S.op8_simhash_dedup(spark, sf).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[root[fps[r.doc_id]]]
