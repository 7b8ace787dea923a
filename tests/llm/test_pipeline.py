import re
import zlib

import numpy as np

import corpus_pipeline
from brightloom.llm import mixing, quality
from brightloom.llm.tokens import default_tokenizer, encoder
from brightloom.plans.shared import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch, seen = docs.columns, Scratch(spark, "test"), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    exact = {}
    for i in ids["quality"]:
        exact[texts[i] or ""] = max(i, exact.get(texts[i] or "", i))
    assert sorted(ids["exact_dedup"]) == sorted(exact.values())
    assert set(ids["near_dedup"]) <= set(ids["exact_dedup"]) and len(set(ids["near_dedup"])) == len(ids["near_dedup"])
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and max(ids["mixing"].count(i) for i in ids["mixing"]) <= 3
    assert set(ids["packing"]) == set(ids["mixing"])
    starts = sum(r.start == 0 for r in seen["packing"])
    assert starts == len(ids["mixing"])


def test_stages_against_brute_force(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs, scratch, rows = first, Scratch(spark, "test"), {"all": first.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = scratch.keep(stage(spark, docs, SF), name)
        rows[name] = docs.collect()
    # Quality: scores of the features of each text, one by one.
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(first, labels.where(~quality.held_out()))
    good = {r.doc_id for r in rows["all"] if model.score(quality.features((r.text or "").encode())[None])[0] >= 0.7}
    assert {r.doc_id for r in rows["quality"]} == good and len(good) > 20
    # Near copies: all pairs of five-word sets.
    sets = {}
    for r in rows["exact_dedup"]:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in rows["near_dedup"]) == sorted({find(d) for d in sets})
    # Mixing: as often as the plan says, and near each source's target.
    plan = {r.doc_id: r for r in mixing.mixing_plan(tables["near_dedup"]).collect()}
    taken = [r.doc_id for r in rows["mixing"]]
    assert {d: taken.count(d) for d in plan} == {d: p.copies for d, p in plan.items()}
    source = {r.doc_id: r.source for r in rows["near_dedup"]}
    for s in set(source.values()):
        mine = [p for d, p in plan.items() if source[d] == s]
        assert abs(sum(p.copies * p.size for p in mine) - mine[0].target) <= max(p.size for p in mine), s
    # Packing: pieces of the library's ids, as many of each as there are copies.
    coder = encoder(default_tokenizer()).tokenizer
    texts = {r.doc_id: r.text for r in rows["near_dedup"]}
    pieces = {}
    for r in rows["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(taken)
    for d, mine in pieces.items():
        ids = np.array(coder.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)
        covered = np.zeros(len(ids), int)
        for r in mine:
            covered[r.start : r.start + r.length] += 1
        assert (covered == taken.count(d)).all()


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a text", "en", "s", 6), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "long " * 30_000, "en", "t", 1)], schema)
    for table in (odd, odd.limit(0)):
        docs, scratch = table, Scratch(spark, "test")
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.keep(stage(spark, docs, SF), name)
        assert docs.columns[0] == "doc_id"
