"""The weighted duplicate: its verdicts, its candidates and its classes."""

import hashlib
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from brightloom.functions import text as X
from brightloom.operators import weighted_dup as W
from brightloom.operators.fingerprints import majority, word_hashes, word_votes
from pyspark.sql import functions as F

SCHEMA = "id long, duration long, mean_hash string, frames array<struct<number:int,hash:string>>, text string, transcript string"
SEEN = ["00" * 8, "11" * 8, "22" * 8]
OFFER = "City hatchback lease 0% apr for 48 months, $199 due at signing, taxes not included, see the dealer for a free test drive"
SPOKEN = "Drive home the new hatchback with no interest for forty eight months."


def item(key, text=OFFER, transcript=SPOKEN, mean="00" * 8, frames=SEEN, duration=10_000):
    return (key, duration, mean, None if frames is None else [(i, h) for i, h in enumerate(frames)], text, transcript)


def found(spark, *items, **how):
    return {r.id: r for r in W.weighted_duplicates(spark.createDataFrame(list(items), SCHEMA), **how).collect()}


def test_a_copy_in_other_case_is_exact(spark):
    got = found(spark, item(1), item(2, OFFER.upper(), mean="00" * 7 + "01"))
    assert (got[1].best_id, got[2].best_id, got[1].verdict) == (2, 1, "exact_duplicate")
    assert got[1].score == pytest.approx(1.0) and got[1].links == 1


def test_another_offer_of_the_same_campaign(spark):
    other = "City hatchback 3.9% apr for 24 months, $349 monthly payments, no cash back, offers end soon, see the dealer for details"
    got = found(spark, item(1), item(2, other, "No payments for ninety days."))
    assert got[2].verdict == "same_campaign_different_offer" and 0.4 < got[2].score < 0.9


def test_near_when_only_one_text_is_alike(spark):
    plain = "An evening by the lake with friends and a campfire under the stars while music plays softly in the background tonight"
    got = found(spark, item(1, plain, "we sing along"), item(2, plain, "they all sleep"))
    assert got[1].verdict == "near_duplicate"


def test_too_little_text_or_other_frames_are_only_related(spark):
    assert found(spark, item(1, "short text", ""), item(2, "short Text", ""))[1].links == 0
    got = found(spark, item(1), item(2, OFFER.upper(), frames=[SEEN[0], "ff" * 8, SEEN[2]]))
    assert (got[1].links, got[1].best_id, got[1].verdict, got[1].score) == (0, None, None, None)


def test_unknown_duration_or_mean_hash_is_close_to_all(spark):
    far = item(5, OFFER.title(), mean="ff" * 8)
    late = item(6, OFFER.upper(), duration=11_501)
    got = found(spark, item(1), item(2, OFFER.upper(), duration=None), item(3, OFFER.lower(), mean=None), item(4, OFFER.swapcase(), duration=None, mean="bad"), far, late)
    pairs = {k: r.links for k, r in got.items()}
    assert pairs == {1: 3, 2: 4, 3: 4, 4: 5, 5: 2, 6: 2}
    assert found(spark, item(1), item(2, OFFER.upper(), duration=11_500))[1].links == 1


def test_items_without_frames_or_texts(spark):
    got = found(spark, item(1, frames=None), item(2, frames=[]), item(3, None, None), item(4, "", ""), item(5, frames=["zz", "1"]))
    assert all(r.links == 0 for r in got.values()) and got[1].class_id == got[2].class_id == got[5].class_id == 1 and got[3].class_id == got[4].class_id == 3
    assert found(spark) == {}


def test_copies_are_one_class_with_one_link(spark):
    got = found(spark, *[item(k) for k in range(100)], *[item(100 + k, OFFER.upper()) for k in range(50)])
    assert Counter((r.class_id, r.copies, r.links, r.best_id) for r in got.values()) == {(0, 100, 1, 100): 100, (100, 50, 1, 0): 50}


def far(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(4)
    flip = lambda h, n: f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(64), n)):016x}"
    rows, said = [], [OFFER + f" code {k} of the new season" for k in range(4)]
    for family in range(12):
        frames = [f"{rng.getrandbits(64):016x}" for _ in range(rng.choice([1, 3, 10, 12]))]
        frames[0] = SEEN[0]  # a frame that all share
        for _ in range(6):
            own = [flip(h, rng.choice([0, 0, 1, 3, 6, 7 if rng.random() < 0.2 else 2])) for h in frames]
            own = own[: rng.randint(max(1, len(own) - 1), len(own))]
            rows.append(item(len(rows), rng.choice(said) + f" {len(rows)}", rng.choice(["", SPOKEN]), rng.choice([None, flip("00" * 8, rng.randint(0, 12))]), own, rng.choice([None, 10_000, 11_000, 12_400])))
    got = found(spark, *rows)
    links = Counter()
    for a in rows:
        for b in rows:
            if a[0] == b[0] or (a[1] and b[1] and abs(a[1] - b[1]) > 1500) or (a[2] and b[2] and far(a[2], b[2]) > 16):
                continue
            close = sum(far(x[1], y[1]) <= 6 for x, y in zip(a[3], b[3]))
            if close / min(len(a[3]), len(b[3])) < 0.9:
                continue
            # Texts differ in a few words, so the verdict hangs on terms and texts alone.
            x, y = (set(zip(w, w[1:])) for w in (re.findall("[a-z0-9]+", r[4].lower()) for r in (a, b)))
            alike = len(x & y) / len(x | y) >= 0.9
            u, v = (plain_terms(f"{r[4]} {r[5]}") for r in (a, b))
            terms = len(u & v) / len(u | v) >= 0.82
            links[a[0]] += alike or a[5] == b[5] or not terms
    assert {k: r.links for k, r in got.items()} == {r[0]: links[r[0]] for r in rows}


def plain_terms(text):
    low = text.lower().replace("\n", " ")
    out = {"value:" + re.sub(r"\s+", "", m.group(0)) for m in re.finditer(X.OFFER_VALUE, low)}
    words = re.findall("[a-z0-9]+", low)
    for i, w in enumerate(words):
        if w in X.OFFER_WORDS:
            out.add(f"term:{w}")
            near = words[max(0, i - 2) : i + 3]
            out |= {"context:" + " ".join(near)} if len(near) > 1 else set()
    return out


def test_commercial_terms(spark):
    texts = [OFFER, "", "free", "Save 5,000.50 dollars\nor 12 %", "no offer", "lease lease lease", "$ 7", "1.2.3 mo due"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("w"))
    for r in rows.select("t", X.commercial_terms(F.col("t"), F.col("w")).alias("s")).collect():
        assert len(set(r.s)) == len(r.s) and set(r.s) == plain_terms(r.t), r.t


def test_sequence_ratio_counts_when_asked_for(spark):
    a = "north wind and rain over all the hills of the western coast until late friday evening and into the night as well"
    b = a.replace("wind", "winds").replace("hills", "hill").replace("coast", "coasts").replace("night", "nights").replace("friday", "fridays")
    assert SequenceMatcher(None, a, b).ratio() > 0.9
    assert found(spark, item(1, a, "same words"), item(2, b, "other"))[1].links == 0
    assert found(spark, item(1, a, "same words"), item(2, b, "other"), ratio=True)[1].verdict == "near_duplicate"


def test_hashes_of_stretches(spark):
    import hashlib

    text = "one two three four five six seven"
    got = {r.part: r.h for r in word_hashes(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string"), "id", "t", 3).collect()}
    words = text.split()
    for part in range(3):
        own = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for i, w in enumerate(words) if i * 3 // 7 == part]
        assert got[part] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)):016x}"
    tie = spark.createDataFrame([(1, 1), (1, -1)], "k int, b long")
    assert majority(tie, ["k"], "b").first().h == "0" * 15 + "1" and majority(tie, ["k"], "b", at_least=True).first().h == "f" * 16


def test_blocks_of_any_size_find_the_same_pairs(spark):
    rng = random.Random(7)
    base = [[rng.getrandbits(63) for _ in range(12)] for _ in range(3)]
    rows = []
    for k in range(60):
        bits = [b ^ (rng.choice([0, 1, 3] * 6 + [127]) << rng.randint(0, 50)) for b in base[k % 3]][: rng.choice([10, 11, 12])]
        rows.append((k, rng.choice([None, 100, 1500, 1600, 3200]), rng.choice([None, 0, 255]), list(enumerate(bits))))
    classes = spark.createDataFrame(rows, "class_id long, duration long, mean long, frames array<struct<number:int,bits:bigint>>")

    def near(a, b):
        close = sum(x[0] == y[0] and bin(x[1] ^ y[1]).count("1") <= 6 for x, y in zip(a[3], b[3]))
        known = [None not in (a[c], b[c]) for c in (1, 2)]
        return close >= 0.9 * min(len(a[3]), len(b[3])) and not (known[0] and abs(a[1] - b[1]) > 1500) and not (known[1] and bin(a[2] ^ b[2]).count("1") > 16)

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}
    for block in (4, 1000):
        got = W.framed_pairs(classes, W.Limits(), W.Scratch(spark, "test"), block).collect()
        assert len(got) == len(want) > 100 and {(r.a, r.b) for r in got} == want


def test_words_vote_where_their_text_lies(spark):
    texts = {1: "One two, TWO; three 4 Één two", 2: "", 3: None, 4: "a " * 40_000 + "b " * 30_000}
    rows = [*texts.items(), (1, "three one")]  # rows of one id vote together
    counted = word_votes(spark.createDataFrame(rows, "id long, t string"), "id", "t", 2)
    assert "Generate explode" not in counted._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in counted._jdf.queryExecution().executedPlan().toString()
    want = {}
    for key, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        for at, word in enumerate(words):
            bits = int(hashlib.md5(word.encode()).hexdigest()[:16], 16)
            own = want.setdefault((key, at * 2 // len(words)), [0] * 65)
            own[64] += 1
            for i in range(64):
                own[i] += bits >> i & 1
    got = {(r.id, r.part): [r[f"v{i % 32}"] >> (32 * (i // 32)) & (1 << 32) - 1 for i in range(64)] + [r.n] for r in counted.collect()}
    assert got == want


def test_close_hashes_are_looked_up_not_compared_with_all(monkeypatch):
    rng = np.random.default_rng(7)
    flipped = lambda v, n: v ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    some = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    close = np.array([flipped(v, n) for v, n in zip(some[:700], [1, 2, 3, 4, 5, 6, 7] * 100)])
    alike = np.array([flipped(some[0], n) for n in (1, 2, 3) * 100])
    for x, y in ((some, np.concatenate([some[:50], close])), (alike, alike), (some, close[:0])):
        want = set(zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= 6))))
        for at_once in (W.AT_ONCE, 50):
            monkeypatch.setattr(W, "AT_ONCE", at_once)
            assert {p for i, j in W._close(x, y, 6) for p in zip(i.tolist(), j.tolist())} == want
    seen = []
    monkeypatch.setattr(W.np, "bitwise_count", lambda v, count=np.bitwise_count: seen.append(v.size) or count(v))
    list(W._close(some, close, 6))
    assert sum(seen) < len(some) * len(close) // 50


def test_sets_of_a_class_go_to_a_cell_once(spark, monkeypatch):
    """A hundred classes alike, all paired, are scored with a row of words each, in one cell as in many."""
    sets = {i: (set(range(i % 7, 40)), set(range(i % 3)), set(range(i % 5, 9))) for i in range(100)} | {200: (set(), set(), set())}
    words = spark.createDataFrame([(i, *map(sorted, s), 70 + i) for i, s in sets.items()], "class_id long, text_grams array<long>, transcript_grams array<long>, terms array<long>, chars int")
    numbers = spark.createDataFrame([(a, b, 1.0) for a in sets for b in sets if a < b], "a long, b long, frames double")
    scored = W._scored

    def counted(*how):
        run = scored(*how)

        def one(pairs, texts):
            if cell == W.CELL:
                assert (pairs.num_rows, texts.num_rows) == (5050, 101)
            return run(pairs, texts)

        return one

    monkeypatch.setattr(W, "_scored", counted)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(a, b): (*map(share, sets[a], sets[b]), 70 + min(a, b) >= 80) for a in sets for b in sets if a < b}
    for cell in (W.CELL, 500):
        rows = W.scored_pairs(numbers, words, W.Limits(), False, W.Scratch(spark, "test"), cell).collect()
        assert len(rows) == len(want) and {(r.a, r.b): (r.text, r.transcript, r.terms, r.enough) for r in rows} == want


def test_hashes_of_stretches_equal_plain_votes(spark, monkeypatch):
    """Stretches of a text are counted together, long texts in slices; a hash is decided in one pass over rows."""
    from brightloom.operators import fingerprints as G

    rng = random.Random(2)
    texts = {1: "", 2: "!", 3: "a", 4: "a b c", **{i: " ".join(f"w{rng.randrange(50)}" for _ in range(i * 7)) for i in range(5, 12)}, 12: None}
    digest = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:8])
    want = {}
    for i, t in texts.items():
        words = re.findall("[a-z0-9]+", t or "")
        for p in range(4):
            some = [digest(w) for k, w in enumerate(words) if k * 4 // len(words) == p]
            if some:
                want[i, p] = "%016x" % sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in some) > len(some))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.id, r.part): r.h for r in word_hashes(rows, "doc_id", "text", 4).collect()} == want
    many = [rng.choices("abcdefgh", k=k) for k in (40, 3)]
    for at_once in (1 << 14, 16):
        monkeypatch.setattr(G, "WORDS_AT_ONCE", at_once)
        for words in many:
            parts = [w.encode() * 8 for w in words]
            got = G._ones_of_stretches(parts, [0, 2])
            assert got.tolist() == [G._ones(b"".join(parts[:2])).tolist(), G._ones(b"".join(parts[2:])).tolist()]
    plan = G.decided(G.word_votes(rows, "doc_id", "text", 4), ["id", "part"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 10
