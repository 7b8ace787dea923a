import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brightloom.llm import alignment as M
from brightloom.llm.tokens import _byte_letters

SF = "/root/testdata/sf0.001"
LETTERS = {c: b for b, c in enumerate(_byte_letters())}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ranges(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def aligned(tokenizers, text):
    """Groups and links of a whole text, by byte ranges; None without tokens."""
    if not text:
        return None
    a, b = tokenizers[0].encode(" " + text, add_special_tokens=False), tokenizers[1].encode(text)
    bytes_a = [bytes(LETTERS[c] for c in t) for t in a.tokens]
    pieces = [tokenizers[1].id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if tokenizers[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ra, rb = ranges(bytes_a), ranges(bytes_b)
    links = [(a.ids[i], b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if max(x[0], y[0]) < min(x[1], y[1])]
    groups, start = [], 0
    for end in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(([a.ids[i] for i, x in enumerate(ra) if start < x[1] <= end], [b[j] for j, y in enumerate(rb) if start < y[1] <= end]))
        start = end
    return groups, links


def told(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def brute(tokenizers, rows):
    found = [(key, aligned(tokenizers, t)) for key, t in rows]
    counts = Counter(link for _, x in found if x for link in x[1])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = Counter()
    for key, x in found:
        if x is None:
            out[(key, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        groups, links = x
        out[(key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), told(groups))] += 1
    return out


def short(docs, n=1500):
    """Texts whose plain alignment, which compares all tokens, is quick."""
    return [(r.doc_id, r.text) for r in docs.collect() if len(r.text) <= n]


def test_table_equals_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = short(docs)
    assert len(rows) > 50
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(tokenizers, rows)
    for size in (5_000, M.BATCH_BYTES):
        got = M.align(table, batch_bytes=size)
        assert got.columns == COLUMNS
        assert Counter(map(tuple, got.collect())) == want


def test_query_covers_whole_texts(spark, tokenizers):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = M.op11_alignment(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    counts = Counter()
    for r in got:
        text = rows[r.doc_id]
        assert (r.n_a, r.n_b) == (len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids), len(tokenizers[1].encode(text)))
        assert r.n_groups <= min(r.n_a, r.n_b) and r.n_links == r.n_a + r.n_b - r.n_groups
        counts["links"] += r.n_links
    assert sum(r.links for r in M.link_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == counts["links"]


def test_units_join_to_whole_texts(tokenizers):
    coder = M.aligner(M.default_tokenizers())
    assert coder.in_units
    rng = random.Random(11)
    plain = list("abcdXY019 .,'\"s  \n\t<>-_  ")
    odd = plain + ["　", "\xa0", " ", "​", "é", "ß", "漢", "字", "😀", "́", "\r", "\x1c", "\x85", "▁", " \n", "'s", "᠎", "﻿", " ", "ﬁ", "\x00", "<s>", "<unk>", "<0x0A>", "<|endoftext|>"]
    for n in range(4000):
        text = "".join(rng.choice(odd if n % 3 else plain) for _ in range(rng.randint(0, 25)))
        want, (got, _) = aligned(tokenizers, text), coder.units([text, rng.choice(odd) * 3])
        assert (want is None) == (got is None), text
        if got:
            assert hashlib.sha256(";".join(u.groups for u in got).encode()).hexdigest() == told(want[0]), text
            assert [int.from_bytes(b"".join(u.links for u in got)[i : i + 8], "little") for i in range(0, 8 * len(want[1]), 8)] == [a * coder.width + b for a, b in want[1]]


def test_labels_and_groups():
    labels = M.label_string(5, np.array([2, 3, 5]), np.array([1, 3, 4, 5])).tobytes()
    assert labels == bytes([2, 1, 3, 2, 3])
    assert M.group_counts(labels) == [(2, 2), (1, 2)] and M.group_counts(b"") == []


def test_odd_tables(spark, tokenizers):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "two words"), (5, "a▁b"), (6, "  lead and trail \n "), (7, "<|endoftext|> <s>"), (8, "x" * 3000), (9, "\U0001f600é漢")]
    table = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, pair long, batch string")
    assert Counter(map(tuple, M.align(table).collect())) == brute(tokenizers, rows)
    groups = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in M.token_groups(table).collect()}
    assert groups[1] == groups[5] == [] and groups[6] == aligned(tokenizers, "  lead and trail \n ")[0]


def test_very_long_text(spark, tokenizers):
    text = "Some words, and more. " * 20_000
    (row,) = M.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_a, row.n_b) == (len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids), len(tokenizers[1].encode(text)))


def test_empty_table(spark):
    assert M.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_tokenizers_are_given_whole_texts(tokenizers, tmp_path):
    a = Tokenizer.from_str(tokenizers[0].to_str())
    from tokenizers.pre_tokenizers import ByteLevel

    a.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    a.save(str(tmp_path / "a.json"))
    coder = M.Aligner(str(tmp_path / "a.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert not coder.in_units
    a.encode_special_tokens = True
    ((unit,), none) = coder.units(["of the of the", ""])
    assert none is None
    assert unit.n_a == len(a.encode(" of the of the", add_special_tokens=False).ids)
