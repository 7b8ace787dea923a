"""Ordered folds against plain Python, over tables and on cases where the order decides."""

import random
import re

from pyspark.sql import functions as F

from brightloom import catalog
from brightloom.functions import merging as M
from brightloom.operators import decide
from brightloom.queries import decisions as D

SF = "/root/testdata/sf0.001"


def plain_alike(a, b):
    if a == b:
        return True
    if len(a) < 5 or len(b) < 5:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if sum(1 for c in short if c in long) / len(long) < 0.6:
        return False
    return not (len(short) < 20 and len(long) - len(short) > 0.5 * len(long))


def plain_fold(rows):
    """Representatives of rows ``(position, key, score, text)`` in order."""
    held = []
    for position, key, score, text in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 62), r[1])):
        found = next((h for h in held if plain_alike(key, h["key"])), None)
        if found is None:
            held.append({"position": position, "key": key, "score": score, "text": text, "rows": 1})
        else:
            found["rows"] += 1
            if score > found["score"]:
                found.update(score=score, text=text)
    return [(i, h["position"], h["key"], h["text"], h["score"], h["rows"]) for i, h in enumerate(held)]


def test_matches():
    rng = random.Random(1)
    words = ["", "a", "abcd", "abcde", "abcdf", "aaaaaaaaaaaaaaaaaaaaaaaa"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))) for _ in range(60)]
    assert all(decide.alike(a, b) == plain_alike(a, b) for a in words for b in words)


def test_first_sight_and_best_text(spark):
    rng = random.Random(2)
    rows = []
    for group in ("a", "b", None):
        for position in range(150):
            key = "".join(rng.choice("ab" if rng.random() < 0.5 else "xyz0123") for _ in range(rng.choice([2, 6, 11, 25, 60])))
            rows.append((group, position, key, float(rng.randint(1, 9)), f"t{position}"))
    rows.append(("c", None, None, None, None))
    table = spark.createDataFrame(rows, "g string, p long, k string, s double, t string").repartition(5)
    got = {}
    for r in decide.first_seen(table, "g", "p", F.col("k"), F.col("s"), F.col("t")).collect():
        got.setdefault(r.g, []).append(tuple(r)[1:])
    for group in ("a", "b"):
        assert sorted(got[group]) == plain_fold([r[1:] for r in rows if r[0] == group])
    assert got["c"] == [(0, None, "", "", 0.0, 1)] and None not in got


def test_the_order_decides(spark):
    # The middle one is like both others, which are not like each other.
    a, b, c = "a" * 10, "a" * 7 + "b" * 3, "b" * 10
    assert decide.alike(a, b) != decide.alike(a, c)
    table = lambda *keys: spark.createDataFrame([("g", i, k) for i, k in enumerate(keys)], "g string, p long, k string")
    fold = lambda *keys: sorted((r.key, r["rows"]) for r in decide.first_seen(table(*keys), "g", "p", F.col("k"), F.lit(1), F.col("k")).collect())
    assert fold(a, c, b) == [(a, 2), (c, 1)] and fold(a, c) == [(a, 1), (c, 1)]


def test_overrides(spark):
    base = spark.createDataFrame([(1, "x", "p", None), (2, "x", "q", "z"), (3, "x", None, "z")], "id long, keep string, a string, b string")
    changes = [(1, 20, "late", "a", "L"), (1, 10, "first", "a", "F"), (1, 10, "also", "b", "B"), (1, 5, "none", "b", None), (1, 1, "odd", "other", "O"), (2, 10, "same", "a", "q"), (2, 11, "next", "a", "N"), (3, 10, "m", "a", "1"), (3, 10, "k", "a", "2"), (9, 1, "r", "a", "x")]
    got = decide.overridden(base, "id", ["a", "b"], spark.createDataFrame(changes, "id long, priority int, rule string, field string, value string")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", "F", "B", ["also", "first"]), (2, "x", "q", "z", []), (3, "x", "2", "z", ["k"])]


def plain_triggers(text):
    for i, (rule, pattern, severity, risk) in enumerate(D.LINE_RULES):
        for n, line in enumerate((text or "").split("\n")):
            if re.search(pattern, line):
                yield i, n, rule, risk, line


def plain_evidence(text):
    rows = []
    for i, n, _, _, line in plain_triggers(text):
        shown = re.sub(r"\s+", " ", line).strip(" ")
        rows.append((i * (1 << 32) + n, re.sub("[^a-z0-9]+", "", line.lower()), float(len(shown) + 2 * shown.count(" ") + 3 * shown.count(". ")), shown))
    return plain_fold(rows)


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_rule_evidence(spark):
    got = {}
    for r in catalog.QUERIES["rule_evidence"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.place, r.key, r.text, r["rows"]))
    want = {k: [(e[0], e[2], e[3], e[5]) for e in plain_evidence(r.text)] for k, r in documents(spark).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_final_classification(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = documents(spark)
    got = {r.doc_id: r for r in catalog.QUERIES["final_classification"](spark, SF).collect()}
    assert set(got) == set(docs)
    changed = 0
    for key, doc in docs.items():
        risks = list(dict.fromkeys(risk for _, _, _, risk, _ in plain_triggers(doc.text) if risk))
        label = labels.get(key)
        signs = risks + (["toxic"] if label and label.toxic == 1 else []) + (["poor"] if label and label.quality == 0 else [])
        fields = {"category": doc.source, "review": "yes" if label and label.toxic == 1 else "no", "audience": "all"}
        applied = set()
        for field in fields:
            wins = sorted((p, rule, value) for p, rule, sign, f, value in D.KNOWLEDGE if f == field and sign in signs)
            if wins and wins[0][2] != fields[field]:
                fields[field] = wins[0][2]
                applied.add(wins[0][:2])
        r, seen = got[key], plain_evidence(doc.text)
        assert (r.category, r.review, r.audience, r.risks, r.applied) == (*fields.values(), ",".join(risks), ",".join(rule for _, rule in sorted(applied)))
        assert (r.sensitive, r.evidence) == (fields["category"] in D.SENSITIVE, len(seen))
        assert r.shown == (max(seen, key=lambda e: (e[4], -e[0]))[3] if seen else None)
        changed += bool(applied)
    assert changed > 10


def test_filled_and_upgraded(spark):
    rows = spark.createDataFrame(
        [
            (1, ["20% off", "Free towing"], ["save 20% off today", "free hitch"], "low", "high", None, 1.0), (2, [], ["x"], "high", "medium", "own", None), (3, None, None, None, "low", "own", 2.0),
            (4, ["A b", "a-b", "c"], None, None, None, None, None), (5, ["a b", ""], ["b a c", "a b d"], "odd", "none", "own", None),
        ],
        "id int, own array<string>, other array<string>, d1 string, d2 string, text string, apr double",
    )
    terms = F.struct("text", "apr")
    other = F.struct(F.lit("other").alias("text"), F.lit(9.0).alias("apr"))
    got = rows.select("id", M.filled_list(F.col("own"), F.col("other")).alias("f"), M.upgraded_list(F.col("own"), F.col("other")).alias("u"), M.once_by_key(F.col("own")).alias("o"), M.denser(F.col("d1"), F.col("d2")).alias("d"), M.filled_struct(terms, other, "text", ["apr"]).alias("t"))
    told = {r.id: (r.f, r.u, r.o, r.d, tuple(r.t)) for r in got.collect()}
    assert told[1] == (["20% off", "Free towing"], ["save 20% off today", "Free towing"], ["20% off", "Free towing"], "high", ("other", 9.0))
    assert told[2][:2] == (["x"], ["x"]) and told[2][3:] == ("high", ("own", 9.0))
    assert told[3][:2] == (None, None) and told[3][3:] == ("low", ("own", 2.0))
    assert told[4][1:3] == (["A b", "a-b", "c"], ["A b", "c"]) and told[5][1] == ["b a c", ""]
