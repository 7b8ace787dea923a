"""Crawl rounds against a plain search, and variants of names against all pairs."""

import random
import re
from collections import Counter

import pytest

from brightloom.operators import frontier, variants


def plain_crawl(seeds, pages, links, depth, visited=(), per_page=None):
    answers, leads = {}, {}
    for page, target in pages:
        answers.setdefault(target, set()).add(page)
    for page, target, priority in (x for x in links if x[1] is not None):
        of = leads.setdefault(page, {})
        of[target] = min(priority, of.get(target, priority))
    out = []
    for entity in {s[0] for s in seeds if s[0] is not None}:
        new = {}
        for e, target, priority in seeds:
            if e == entity and target is not None:
                new[target] = min(priority, new.get(target, priority))
        asked, read = set(new), {p for e, p in visited if e == entity}
        for turn in range(1, depth + 1):
            found = {}
            for target, priority in new.items():
                for page in answers.get(target, ()):
                    if page not in read:
                        found[page] = min(found.get(page, (priority, target)), (priority, target))
            out += [(entity, page, turn, *why) for page, why in found.items()]
            read |= set(found)
            new = {}
            for page in found:
                for target, priority in sorted(leads.get(page, {}).items(), key=lambda x: (x[1], x[0]))[:per_page]:
                    if target not in asked:
                        new[target] = min(priority, new.get(target, priority))
            asked |= set(new)
    return Counter(out)


@pytest.mark.parametrize("depth,per_page", [(1, None), (3, None), (6, 2)])
def test_crawl_equals_a_plain_search(spark, depth, per_page):
    rng = random.Random(depth)
    key = lambda: f"k{rng.randrange(25)}"
    pages = [(p, key()) for p in range(40) for _ in range(rng.randint(0, 2))] + [(3, None)]
    links = [(p, key(), rng.randint(0, 3)) for p in range(40) for _ in range(rng.randint(0, 4))] + [(1, None, 0)]
    seeds = [(e, key(), rng.randint(0, 2)) for e in range(5) for _ in range(2)] + [(None, "k1", 0), (1, None, 0)]
    visited = [(0, p) for p in range(0, 40, 2)]
    got = frontier.crawl(
        spark.createDataFrame(seeds, "entity int, target string, priority int"), spark.createDataFrame(pages, "page int, target string"), spark.createDataFrame(links, "page int, target string, priority int"),
        depth, spark.createDataFrame(visited, "entity int, page int"), per_page,
    )
    assert got.columns == ["entity", "page", "depth", "priority", "target"]
    assert Counter(map(tuple, got.collect())) == plain_crawl(seeds, pages, links, depth, visited, per_page)


def test_crawl_without_seeds(spark):
    none = spark.createDataFrame([], "entity int, target string, priority int")
    pages = spark.createDataFrame([(1, "a")], "page int, target string")
    assert frontier.crawl(none, pages, pages.selectExpr("page", "target", "1 AS priority"), 3).collect() == []


def plain_found(candidate, base):
    i = j = 0
    while i < len(candidate) and j < len(base):
        size = len(base[j])
        if candidate[i] == base[j]:
            i, j = i + 1, j + 1
        elif size >= 2 and "".join(w[0] for w in candidate[i : i + size]) == base[j]:
            i, j = i + size, j + 1
        else:
            i += 1
    return j == len(base)


def plain_bases(names, least=4, dropped=()):
    rows = {(" ".join(re.findall("[a-z0-9]+", (n or "").lower())), " ".join(re.findall("[a-z0-9]+", (b or "").lower())) or None) for n, b in names}
    rows = {r for r in rows if r[0]}
    out = {}
    for name, brand in rows:
        fits = [b for b, other in rows if len(b.replace(" ", "")) >= least and b not in dropped and len(b) < len(name) and (brand is None or other is None or brand == other) and len(b.split()) < len(name.split())]
        fits = [b for b in fits if name.startswith(b + " ") or plain_found(name.split(), b.split())]
        if fits:
            out[name, brand] = min(fits, key=lambda b: (-len(b), b))
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    names = [(" ".join(word() for _ in range(rng.randint(1, 6))), rng.choice([None, "A", "b"])) for _ in range(300)]
    names += [(None, "A"), ("", None), ("--", "b"), ("Grand Touring  Four-Door", "A"), ("GT four", "a"), ("gt FOUR door", None), ("grand", "b")]
    table = spark.createDataFrame(names, "name string, brand string")
    got = {(r.name, r.brand): r.base for r in variants.base_names(table, brand_col="brand", least_chars=3).collect()}
    assert got == plain_bases(names, 3) and got["grand touring four door", "a"] == "gt four door"
    without = {r.name: r.base for r in variants.base_names(table.select("name"), dropped=("gt four",)).collect()}
    assert without == {n: b for (n, _), b in plain_bases([(n, None) for n, _ in names], 4, ("gt four",)).items()}


def test_variants_without_names(spark):
    assert variants.base_names(spark.createDataFrame([], "name string")).collect() == []
