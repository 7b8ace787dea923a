"""Broken JSON against a parser that goes character by character."""

import json
import random
import re

from pyspark.sql import functions as F

from brightloom import catalog
from brightloom.functions import salvage
from brightloom.queries import payloads

SF = "/root/testdata/sf0.001"


def tokens(text):
    """Strings, marks, and numbers and words that something follows, with their kind."""
    at, out = 0, []
    while at < len(text):
        c = text[at]
        if c == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if end < len(text):
                out.append(("scalar", text[at : end + 1]))
                at = end + 1
            else:
                at += 1  # cut off: what is in it is read for what it is
            continue
        if c in "{}[],:":
            out.append((c, c))
            at += 1
            continue
        if c in "-0123456789tfn" and not (at and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "_.+-")):
            end = at
            while end < len(text) and text[end] not in " \t\n\r\x0b\f,}]:":
                end += 1
            word = text[at:end]
            try:
                plain = end < len(text) and not isinstance(json.loads(word), (str, dict, list)) and word not in ("NaN", "Infinity", "-Infinity")
            except ValueError:
                plain = False
            if plain:
                out.append(("scalar", word))
                at = end
                continue
        at += 1
    return out


class Reader:
    """Reads objects and lists by recursion; ``shut`` says which brackets a mark closes beyond the innermost."""

    def __init__(self, text):
        self.tokens, self.at, self.open, self.shut = tokens(text), 0, [], 0

    def next(self):
        if self.shut or self.at == len(self.tokens):
            return None, None
        self.at += 1
        return self.tokens[self.at - 1]

    def closes(self, mark):
        """Whether the innermost is closed now: by its own mark, or as part of an outer one's."""
        own = {"}": "{", "]": "["}[mark]
        if own not in self.open:
            return False
        self.shut = len(self.open) - max(i for i, o in enumerate(self.open) if o == own)
        return True

    def leave(self):
        self.open.pop()
        self.shut = max(0, self.shut - 1)

    def object(self):
        self.open.append("{")
        pairs, key, colon = [], None, False
        while True:
            kind, token = self.next()
            if kind is None or (kind in "}]" and self.closes(kind)):
                break
            if kind == ",":
                key, colon = None, False
            elif key is not None and colon and kind in ("scalar", "{", "["):
                value = token if kind == "scalar" else self.object() if kind == "{" else self.list()
                pairs.append(f"{key}:{value}")
                key, colon = None, False
            elif key is not None and colon:
                pass
            elif kind == "scalar" and token[0] == '"':
                key = token
            elif kind == ":" and key is not None:
                colon = True
        self.leave()
        return "{" + ",".join(pairs) + "}"

    def list(self):
        self.open.append("[")
        items = []
        while True:
            kind, token = self.next()
            if kind is None or (kind in "}]" and self.closes(kind)):
                break
            if kind in ("scalar", "{", "["):
                items.append(token if kind == "scalar" else self.object() if kind == "{" else self.list())
        self.leave()
        return "[" + ",".join(items) + "]"


def plain(text):
    if text is None:
        return None
    if "```" in text:
        text = text.split("```", 1)[1].removeprefix("json")
    if "{" not in text:
        return None
    reader = Reader(text[text.index("{") :])
    reader.next()
    return re.sub(r'(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|\\', lambda m: m[1] or "", reader.object())


def salvaged(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r.j for r in rows.select("n", salvage.salvaged_json(F.col("t")).alias("j")).orderBy("n").collect()]


def test_known_breaks(spark):
    cases = {
        '{"a": 1, "b": "x"}': '{"a":1,"b":"x"}',
        'Sure: {"type": "view", "tags": ["a", "b", "ok": true, "note": "cut': '{"type":"view","tags":["a","b","ok",true,"note"]}',
        '{"a": {"b": [1, 2, {"c": 3': '{"a":{"b":[1,2,{}]}}',
        '{"a": "br{ace", "b": "q\\"uote", "c': '{"a":"br{ace","b":"q\\"uote"}',
        '{"a": [1, 2}, "b": 3}': '{"a":[1,2]}',
        '{"a": 1 "b": 2,, "c" "d": 3}': '{"a":1,"b":2,"d":3}',
        '{"a": ] 1, "b": nul}': '{"a":1}',
        "no object": None,
        "": None,
        None: None,
        "{": "{}",
        'x ```json\n{"a": 1}\n``` {"b": 2}': '{"a":1}',
        '{"a": 12': "{}",
        '{"a": 1} {"b": 2}': '{"a":1}',
        '{"a": "\\x\\n\\\\"}': '{"a":"x\\n\\\\"}',
        '{"a": 007, "b": -0.5e3, "c": +1}': '{"b":-0.5e3}',
    }
    assert salvaged(spark, list(cases)) == list(cases.values())


def test_random_breaks_equal_the_plain_reader(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.25:
            return {rng.choice(["a", "b{", 'c"', "d\\", "é,"]) + str(i): value(depth - 1) for i in range(rng.randint(0, 3))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, -2.5, 1e30, True, None, "text", "a [b] {c}", 'say "x": 1,', "", "null", "漢 \n \\"])

    texts = []
    for _ in range(1500):
        whole = json.dumps({"k": value(3), "l": value(3)}, ensure_ascii=rng.random() < 0.5)
        chars = list(whole)
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(chars))
            chars[at : at + rng.choice([0, 1])] = rng.choice(["", "", ",", "}", "]", "{", "[", ":", "x"])
        broken = "".join(chars)
        texts.append(rng.choice(["", "Sure: ", "```json\n"]) + broken[: rng.choice([len(broken), rng.randint(0, len(broken))])])
    got = salvaged(spark, texts)
    for text, j in zip(texts, got):
        assert j == plain(text), text
        assert j is None or json.loads(j, strict=False) is not None


def test_query_equals_the_plain_reader(spark):
    said = {r.doc_id: r.said for r in payloads._answers(spark, SF).collect()}
    rows = catalog.QUERIES["salvaged_json"](spark, SF).collect()
    assert {r.doc_id: r.json for r in rows} == {k: plain(t) for k, t in said.items()}
    assert len({len(t) for t in said.values()}) > 50
    for r in rows:
        if r.json:
            assert r.lang == json.loads(r.json).get("meta", {}).get("lang")


def test_long_strings(spark):
    text = '{"a": "' + "x\\n" * 200_000 + '", "b": [' + "1," * 2000
    (got,) = salvaged(spark, [text])
    assert got == '{"a":"' + "x\\n" * 200_000 + '","b":[' + ",".join("1" * 2000) + "]}"


def test_placeholders(spark):
    rows = spark.createDataFrame([(x,) for x in ["null", " None ", "n/a", "string", "strings", None, ""]], "x string")
    assert [r.y for r in rows.select(salvage.without_placeholder(F.col("x")).alias("y")).collect()] == [None, None, None, None, "strings", None, ""]


def test_a_text_is_folded_once(spark):
    rows = spark.range(1).select(salvage.salvaged_json(F.concat(F.lit('{"a": '), F.col("id").cast("string"))).alias("x"))
    rows.collect()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
