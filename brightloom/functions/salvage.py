"""JSON objects out of texts that hold broken ones, as an expression.

A text is cut into JSON's tokens by one regular expression, so a string is one
step however long it is, and braces in strings are none. The tokens are folded
with a stack of open brackets. What is read as a whole stays:

* a string without its closing quote and a number or word that the text ends
  with are cut off and left out, and so is a key without a value;
* missing commas and stray ones don't matter; in a list a colon is a comma;
* a closing bracket closes all that was opened after its own opening one; one
  without an opening one is left out;
* at the end of the text all that is open is closed;
* a backslash that begins no escape goes.

The first object counts, after a code fence if there is one. No object, null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, a bracket or mark, or a number or word that something follows.
TOKEN = r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[{}\[\],:]|(?<![0-9A-Za-z_.+-])(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?=[\s,}\]:]))'
#: An escape, or a backslash that begins none and goes.
ESCAPE = r'(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|\\'
#: What a model writes for nothing.
PLACEHOLDERS = ("null", "none", "n/a", "string")

_STATE = "struct<out:string,open:string,pending:string,at:string>"


def _state(out: Column, open_: Column, pending: Column, at: Column) -> Column:
    return F.struct(out.alias("out"), open_.alias("open"), pending.alias("pending"), at.alias("at")).cast(_STATE)


def _closers(open_: Column) -> Column:
    """What closes open brackets, the innermost first."""
    return F.translate(F.reverse(open_), "{[", "}]")


def _kind(t: Column) -> Column:
    return F.when(F.startswith(t, F.lit('"')), F.lit("string")).when(t.isin("{", "["), F.lit("opens")).when(t.isin("}", "]"), F.lit("closes")).when(t == ",", F.lit("comma")).when(t == ":", F.lit("colon")).otherwise(F.lit("plain"))


def _step(s: Column, token: Column) -> Column:
    """One token and its kind. ``open`` are the open brackets; ``at`` what may come: a ``key``, its ``colon``, a ``value``, the ``next`` pair, an ``item``, or nothing more (``done``)."""
    none, out, open_ = F.lit(None), s["out"], s["open"]
    inner = F.right(open_, F.lit(1))
    more = F.when(F.right(out, F.lit(1)).isin("{", "["), out).otherwise(F.concat(out, F.lit(",")))
    t, kind = token["t"], token["kind"]
    # A closing bracket and everything that was opened since its opening one.
    own = F.translate(t, "}]", "{[")
    depth = F.length(open_) - F.instr(F.reverse(open_), own)  # brackets that stay open
    left = F.left(open_, depth)
    closed = F.concat(out, F.left(_closers(open_), F.length(open_) - depth))
    after = F.when(depth == 0, F.lit("done")).when(F.right(left, F.lit(1)) == "{", F.lit("next")).otherwise(F.lit("item"))
    closes = F.when(F.instr(open_, own) > 0, _state(closed, left, none, after)).otherwise(s)
    opened = lambda lead: _state(F.concat(lead, t), F.concat(open_, t), none, F.when(t == "{", F.lit("key")).otherwise(F.lit("item")))
    waits = _state(out, open_, t, F.lit("colon"))
    in_list = F.when(kind.isin("string", "plain"), _state(F.concat(more, t), open_, none, F.lit("item"))).when(kind == "opens", opened(more)).otherwise(s)
    value = F.concat(more, s["pending"], F.lit(":"))
    in_object = (
        F.when(kind == "comma", _state(out, open_, none, F.lit("key")))
        .when((s["at"] == "value") & kind.isin("string", "plain"), _state(F.concat(value, t), open_, none, F.lit("next")))
        .when((s["at"] == "value") & (kind == "opens"), opened(value))
        .when(s["at"] == "value", s)
        .when(kind == "string", waits)
        .when((s["at"] == "colon") & (kind == "colon"), _state(out, open_, s["pending"], F.lit("value")))
        .otherwise(s)
    )
    return F.when(s["at"] == "done", s).when(s["at"] == "start", F.when(t == "{", _state(t, t, none, F.lit("key"))).otherwise(s)).when(kind == "closes", closes).when(inner == "[", in_list).otherwise(in_object)


def salvaged_json(text: Column) -> Column:
    """The first object of a text as valid JSON, with what can be read of it; null without one."""
    body = F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, r"^[\s\S]*?```(?:json)?", "")).otherwise(text)
    begin = F.instr(body, "{")
    tokens = F.regexp_extract_all(F.substr(body, F.greatest(begin, F.lit(1))), F.lit(TOKEN), F.lit(1))
    first = _state(F.lit(""), F.lit(""), F.lit(None), F.lit("start"))
    # Kinds are told once a token; what is null for nothing is told at the fold's end, so that there is one fold.
    tokens = F.transform(tokens, lambda t: F.struct(t.alias("t"), _kind(t).alias("kind")))
    folded = F.aggregate(tokens, first, _step, lambda s: F.when(s["out"] != "", F.concat(s["out"], _closers(s["open"]))))
    return F.when(begin > 0, F.regexp_replace(folded, ESCAPE, "$1"))


def without_placeholder(x: Column) -> Column:
    """Null for what stands for nothing."""
    return F.when(~F.lower(F.trim(x)).isin(*PLACEHOLDERS), x)
