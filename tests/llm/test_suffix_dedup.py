import hashlib
import random

import numpy as np

from brightloom.llm import suffix_dedup as D


def brute(docs):
    """docs in order: (id, bytes) -> removed flags, by a set of all strings so far."""
    seen, out = set(), []
    for _, raw in docs:
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        out.append(gone)
    return out


def expected(raw, gone):
    spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    kept = bytes(b for b, g in zip(raw, gone) if not g)
    return len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_columns_are_sorted_as_suffixes():
    rng = np.random.default_rng(4)
    members = rng.integers(97, 99, (40, D.COLUMNS)).astype(np.uint8)
    for i in range(1, 40):
        members[i, : rng.integers(60, 168)] = members[rng.integers(0, i), : 1][0]
        k = rng.integers(0, i)
        a = rng.integers(0, 60)
        members[i, a : a + 105] = members[k, a : a + 105]
    low, high = np.zeros(40, int), np.full(40, D.COLUMNS)
    high[5], low[7] = 130, 20
    got = D.repeated_strings(members, low, high)
    for j in range(D.WINDOW):
        seen = set()
        for i in range(40):
            if low[i] <= j and high[i] >= j + 100:
                s = members[i, j : j + 100].tobytes()
                assert got[i, j] == (s in seen)
                seen.add(s)
            else:
                assert not got[i, j]


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(40), "é" * 30 + prose(12)
    out = [prose(120) for _ in range(12)]
    out += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(10)]
    out += [prose(5) + (line + "\n") * 3 + prose(9), "a" * 700, "b" + "a" * 250, "xy" * 300, out[3], out[3][5:-7], out[0] + out[1], "", passage[:100], passage[:99], passage[1:101]]
    return out


def run(spark, docs, schema="doc_id long, text string, spans string"):
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], schema).repartition(3)
    from brightloom.plans.shared import Scratch

    table = Scratch(spark, "test").keep(table, "docs")
    rows = D.remove_repeats(table).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}


def test_against_brute_force(spark, monkeypatch):
    docs = list(enumerate(texts()))
    random.Random(1).shuffle(docs)
    order = sorted((i, (t or "").encode()) for i, t in docs)
    want = {i: expected(raw, gone) for (i, raw), gone in zip(order, brute(order))}
    assert run(spark, docs) == want


def test_collections_are_sorted_whole_in_any_batches():
    import pyarrow as pa

    rows = []
    for n, t in enumerate(t.encode() for t in texts() if len(t) > 200):
        at, h = D.anchors(t)
        for a, x in zip(at.tolist(), h.tolist()):
            begin = a - D.SIDE
            low, high = max(0, -begin), min(D.COLUMNS, len(t) - begin)
            rows.append((x, -1, 0, b"\0" * low + t[begin + low : begin + high] + b"\0" * (D.COLUMNS - high), low, high, n, a))
    rows.sort(key=lambda r: (r[0], r[6], r[7]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["h", "part", "route", "around", "low", "high", "row_no", "at"])
    solve = lambda *some: [tuple(r.values()) for b in D._resolve(iter(some)) for r in b.to_pylist()]
    whole, D.AT_ONCE = solve(batch), 7
    try:
        assert solve(batch) == whole
        assert solve(*(batch.slice(i, 5) for i in range(0, len(batch), 5))) == whole
    finally:
        D.AT_ONCE = 8192


def test_hot_anchors_are_split(spark, monkeypatch):
    docs = list(enumerate(texts() * 2))
    order = [(i, (t or "").encode()) for i, t in docs]
    want = {i: expected(raw, gone) for (i, raw), gone in zip(order, brute(order))}
    monkeypatch.setattr(D, "HOT", 3)
    assert run(spark, docs) == want


def test_one_anchor_in_very_many_surroundings(spark):
    # A line of 130 bytes between words that no two documents share, and for some a longer passage.
    line = "".join(random.Random(6).choices("klmnopqrst", k=130))
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=60))
    docs = [(i, f"{word()} {line} {word()}") for i in range(100_000)]
    docs[77_777] = (77_777, f"{word()} {docs[5][1]}")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n) for r in D.remove_repeats(table).selectExpr("doc_id", "n_removed", "size(spans) AS n").collect()}
    assert got.pop(0) == (0, 0) and got[77_777][0] >= len(docs[5][1])
    # The line with a blank on either side, and letters next to it where an earlier document has the same.
    assert all(n == 1 and removed >= 132 for removed, n in got.values())


def test_long_texts_have_the_same_anchors():
    text = bytes(np.random.default_rng(3).integers(97, 103, 9000, dtype=np.uint8))
    whole, D.PIECE = D.anchors(text), 1000
    try:
        parts = D.anchors(text)
    finally:
        D.PIECE = 1 << 21
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_nulls_repeats_and_empty(spark):
    long = "0123456789" * 9 + "abcdefghijklmno"
    got = run(spark, [(None, long), (5, long), (7, None), (9, "x")])
    assert got[None][1] == 0 and got[5][1] == len(long) and got[7][:3] == (0, 0, 0) and got[9][:2] == (1, 0)
    assert D.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    order = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {i: expected(raw, gone) for (i, raw), gone in zip(order, brute(order))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.op6_suffix_dedup(spark, sf).collect()}
    assert got == want


def test_scans_that_split_the_input_elsewhere(spark, monkeypatch):
    from brightloom.plans.shared import Scratch

    docs = list(enumerate(texts()))
    random.Random(2).shuffle(docs)
    order = sorted((i, (t or "").encode()) for i, t in docs)
    want = {i: expected(raw, gone) for (i, raw), gone in zip(order, brute(order))}
    setting, keep, sizes = "spark.sql.files.maxPartitionBytes", Scratch.keep, ["3000", "128m", "5000", "9000", "64m"] * 9
    before = spark.conf.get(setting)

    def moved(self, df, name, *a):
        out = keep(self, df, name, *a)
        spark.conf.set(setting, sizes.pop())
        return out

    monkeypatch.setattr(Scratch, "keep", moved)
    try:
        table = keep(Scratch(spark, "test"), spark.createDataFrame(docs, "doc_id long, text string").repartition(7), "docs")
        rows = D.remove_repeats(table).collect()
    finally:
        spark.conf.set(setting, before)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows} == want
