"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans, which may overlap. Candidates of the four
base kinds that pass their check are reported as they are. Candidates of the
other kinds are scored by gradient-boosted trees over features of their format
and context, and reported where the score reaches their kind's threshold.

Nobody labels these candidates, so rules of the formats do: the checks of the
base kinds, the numbering plan of national phone numbers, the ranges of social
security numbers, the remainder of bank account numbers, the common endings of
written-out mail addresses. The trees see format and context, so a number that
keeps the rule but stands where such numbers never do scores low. A kind's
threshold is the least score from which the share of positives among held-out
candidates reaches ``precision``; a kind with fewer than ``least_held`` held-out
candidates can't be calibrated and is not reported. The fit and the thresholds
use every different candidate that a rule tells about: features are small whole
numbers, so candidates alike in all of them are one row with their number as its
weight, and the trees take the values as categories, for which Spark draws no
sample to find its splits. All base kinds weigh no more than all further ones.

A further span that overlaps one of a base kind says nothing new and is left
out: ``(301) 555-0346`` in ``+1 (301) 555-0346`` is the phone number's.

A span's place comes from the text between matches: a text is split at a
pattern's matches, and lengths are summed up to each match. Offsets are code
points, the end exclusive.

Defined cases: null and empty texts have no spans; a very long text is searched
whole; where the examples have one label only, no candidate beyond the base
kinds is reported; further spans that overlap each other are all reported;
repeated rows report alike; an empty table gives an empty result; columns other
than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("national", "ssn", "iban", "masked_email")
KINDS = (*BASE_KINDS, *MORE_KINDS)
LEAST_HELD = 20  # held-out candidates of a kind, from which its threshold is its own
PRECISION = 0.95
TREES, DEPTH, SEED = 16, 4, 7
STEPS = 64  # of a share or a length, as a feature
LEFT, RIGHT = 24, 12  # characters of context

# Repetitions of a group run 500 at a time inside an atomic group: the matches are the
# same, and the matcher's stack doesn't grow with a text's length. A lookbehind keeps a run
# from being tried again at each of its characters; \G allows it right after a match.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?>(?:\.{_LABEL}++){{1,500}})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?>(?:[\x20-]?[0-9]){1,500})++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": r"[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z]{2,24}",
}
_DIGIT = r"[0-9]"
#: What a text must hold to be searched for a kind at all.
NEEDS = {"email": "@", "ip": _DIGIT, "card": _DIGIT, "phone": r"\+[0-9]", "national": r"[0-9]{4}", "ssn": r"-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}", "masked_email": r"[\[(](?:at|AT)[\])]"}
FEATURES = (*(f"is_{k}" for k in MORE_KINDS), "first_digit", "first_repeats", "middle_digit", "remainder", "ending", "length", "digits", "letters", "upper", "spaces", "marks", "distinct", "opens_plus", "opens_mark", "cue_contact", "cue_number", "left_letter", "left_digit", "right_letter", "right_digit", "left_colon")


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind in order, each with the length of the text before it and its context."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(
        matches,
        gaps,
        lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.right(g, F.lit(LEFT)).alias("before"), F.left(g, F.lit(RIGHT)).alias("opening")),
    )
    return F.when(F.regexp_like(text, F.lit(NEEDS[kind])), F.struct(F.lit(kind).alias("kind"), pairs.alias("pairs")))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _doubled(F.try_to_number(d, F.lit("9")).cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)


def _passes(kind: Column, match: Column) -> Column:
    """The check of the base kinds; null for the others."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.regexp_like(match, F.lit(rf"^{part}\.{part}\.{part}\.{part}$")))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
    )


#: Endings of mail addresses that are common.
ENDINGS = ["com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "us", "uk", "de", "fr", "es", "it", "eu"]


def _remainder(match: Column) -> Column:
    """What a bank account number leaves modulo 97, letters as numbers, the first four characters last."""
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda r, v: F.when(v > 9, r * 100 + v).otherwise(r * 10 + F.coalesce(v, F.lit(0))) % 97)


def _ending(match: Column) -> Column:
    return F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1))


def _keeps_rule(kind: Column, match: Column) -> Column:
    """Whether a candidate of the further kinds keeps the rule of its format."""
    return (
        F.when(kind == "national", F.regexp_like(match, F.lit(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")))
        .when(kind == "ssn", ~F.regexp_like(match, F.lit("^(?:000|666|9)|-00-|0000$")))
        .when(kind == "iban", _remainder(match) == 1)
        .when(kind == "masked_email", _ending(match).isin(ENDINGS))
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_no, doc_id, text_sha256, kind, start, end, match, before, after, passes``; a row of nulls for a text without any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
    kinds = F.filter(F.array(*[_found(F.col("text"), k) for k in KINDS]), lambda x: x.isNotNull() & (F.size(x["pairs"]) > 1))
    rows = rows.select("row_no", "doc_id", "text_sha256", F.explode_outer(kinds).alias("k"))
    # The last pair has no match; it is what follows the last match.
    rows = rows.select("row_no", "doc_id", "text_sha256", F.col("k.kind").alias("kind"), F.posexplode_outer("k.pairs").alias("pos", "p"))
    order = Window.partitionBy("row_no", "kind").orderBy("pos")
    length = F.coalesce(F.length("p.match"), F.lit(0))
    rows = rows.select(
        "row_no",
        "doc_id",
        "text_sha256",
        "kind",
        F.col("p.match").alias("match"),
        F.col("p.before").alias("before"),
        F.lead("p.opening").over(order).alias("after"),
        F.sum(F.col("p.gap").cast("long") + length).over(order).alias("end"),
    )
    rows = rows.where(F.col("kind").isNull() | F.col("match").isNotNull())
    return rows.withColumn("start", F.col("end") - F.length("match")).withColumn("passes", _passes(F.col("kind"), F.col("match")))


def _features(rows: DataFrame) -> DataFrame:
    """Format and context of a candidate as whole numbers from 0 to ``STEPS``."""
    m, before, after = F.coalesce("match", F.lit("")), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    n = F.greatest(F.length(m), F.lit(1))

    def share(pattern: str) -> Column:
        return F.round(F.regexp_count(m, F.lit(pattern)) * STEPS / n)

    low = F.lower(before)
    number = lambda pattern: F.coalesce(F.regexp_extract(m, pattern, 1).try_cast("int") + 1, F.lit(0))
    values = {f"is_{k}": F.coalesce(F.col("kind") == k, F.lit(False)) for k in MORE_KINDS} | {
        "first_digit": number("^[^0-9]*([0-9])"),
        "first_repeats": F.regexp_like(m, F.lit(r"^[^0-9]*([0-9])\1\1")),
        "middle_digit": number("^[^0-9]*[0-9]+[^0-9]+([0-9])"),
        "remainder": F.when(F.col("kind") == "iban", _remainder(m) == 1).otherwise(False),
        "ending": _ending(m).isin(ENDINGS),
        "length": F.least(n, F.lit(STEPS)),
        "digits": share("[0-9]"),
        "letters": share("[A-Za-z]"),
        "upper": share("[A-Z]"),
        "spaces": share(r"\x20"),
        "marks": share(r"[^A-Za-z0-9\x20]"),
        "distinct": F.round(F.size(F.array_distinct(F.split(F.left(m, F.lit(STEPS)), ""))) * STEPS / F.least(n, F.lit(STEPS))),
        "opens_plus": m.startswith("+"),
        "opens_mark": F.regexp_like(m, F.lit("^[^A-Za-z0-9]")),
        "cue_contact": F.regexp_like(low, F.lit("phone|tel|call|fax|mobile|mail|contact|reach")),
        "cue_number": F.regexp_like(low, F.lit("ssn|social|iban|account|card|bank|passport|id")),
        "left_letter": F.regexp_like(before, F.lit("[A-Za-z]$")),
        "left_digit": F.regexp_like(before, F.lit(r"[0-9][\x20.,-]?$")),
        "right_letter": F.regexp_like(after, F.lit("^[A-Za-z]")),
        "right_digit": F.regexp_like(after, F.lit(r"^[\x20.,-]?[0-9]")),
        "left_colon": F.regexp_like(before, F.lit(r"[:=#]\x20?$")),
    }
    return rows.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])


def fit_trees(found: DataFrame, scratch: Scratch, precision: float = PRECISION, least_held: int = LEAST_HELD) -> tuple[PipelineModel | None, dict[str, float]]:
    """Trees over candidates that a rule tells about, and for each further kind the score from which it is reported."""
    told = F.coalesce("passes", _keeps_rule(F.col("kind"), F.col("match")))
    known = _features(found.withColumn("told", told).where("told IS NOT NULL"))
    # Equal examples are one example; a third of them is held out.
    known = known.select(F.col("told").cast("double").alias("label"), "kind", F.xxhash64("match", "told", "kind", *FEATURES).alias("h"), *FEATURES).dropDuplicates(["h"])
    known = known.groupBy("label", "kind", (F.pmod("h", F.lit(3)) == 0).alias("held"), *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    known = scratch.keep(known, "examples")
    fit, held = known.where("NOT held").withColumn("more", F.col("kind").isin(*MORE_KINDS)), known.where("held")
    n_more, n_base = fit.agg(F.sum(F.when(F.col("more"), F.col("n"))), F.sum(F.when(~F.col("more"), F.col("n")))).first()
    share = min(1.0, n_more / n_base) if n_more and n_base else 1.0
    fit = fit.withColumn("weight", F.col("n") * F.when(F.col("more"), 1.0).otherwise(share))
    labels = fit.groupBy("label").count().collect()  # two rows at most
    if len(labels) < 2:
        return None, {}
    if sum(r["count"] for r in labels) > STEPS:  # Spark takes no more values of a category than rows; of so few it takes no sample
        category = {"ml_attr": {"type": "nominal", "num_vals": STEPS + 1}}
        fit = fit.withColumns({f: F.col(f).alias(f, metadata=category) for f in FEATURES})
    trees = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=STEPS + 1, seed=SEED)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    model = PipelineModel([assembler, trees.fit(assembler.transform(fit))])
    # At most 101 rows a kind: positives and candidates from each hundredth of the score.
    bins = score(model, held).groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("all")).collect()

    def least_score(rows: list) -> float:
        threshold, good, all_ = 2.0, 0.0, 0
        for row in sorted(rows, key=lambda r: -r["bin"]):
            good, all_ = good + row["good"], all_ + row["all"]
            if good >= precision * all_:
                threshold = row["bin"] / 100
        return threshold

    of = {k: [r for r in bins if r["kind"] == k] for k in MORE_KINDS}
    return model, {k: least_score(rows) for k, rows in of.items() if sum(r["all"] for r in rows) >= least_held}


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with features, and with the probability that a candidate is personal data as ``score``."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION, least_held: int = LEAST_HELD) -> DataFrame:
    """``doc_id, text_sha256, spans`` for every row: spans is an array of kind number, start, end and kind, in that order."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(candidates(docs, id_col, text_col), "candidates")
    model, thresholds = fit_trees(found, scratch, precision, least_held)
    base = found.where(F.col("kind").isNull() | F.col("passes"))
    more = found.where(F.col("kind").isNotNull() & F.col("passes").isNull())
    if model is None:
        chosen = base
    else:
        least = F.lit(2.0)
        for k, v in thresholds.items():
            least = F.when(F.col("kind") == k, v).otherwise(least)
        chosen = base.unionByName(score(model, _features(more)).where(F.col("score") >= least).select(*base.columns))
    # A row whose candidates all fail still has to appear.
    rows = found.select("row_no", "doc_id", "text_sha256").distinct().select("row_no", "doc_id", "text_sha256", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("start", "long"), ("end", "long"))])
    chosen = rows.unionByName(_without_covered(chosen.where(F.col("kind").isNotNull()).select(*rows.columns)))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(number.alias("kind_no"), "start", "end", "kind"))
    return chosen.groupBy("row_no").agg(F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"), F.sort_array(F.collect_list(span)).alias("spans")).drop("row_no")


def _without_covered(chosen: DataFrame) -> DataFrame:
    """Spans without those of further kinds that overlap one of a base kind in the same row."""
    is_base = F.col("kind").isin(*BASE_KINDS)
    # Base spans of one row may overlap: what counts is the farthest end before, and the nearest start behind.
    ahead = Window.partitionBy("row_no").orderBy("start", ~is_base).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row_no").orderBy(F.desc("start"), is_base).rowsBetween(Window.unboundedPreceding, -1)
    marked = chosen.withColumn("upto", F.max(F.when(is_base, F.col("end"))).over(ahead)).withColumn("from", F.min(F.when(is_base, F.col("start"))).over(behind))
    covered = (F.coalesce("upto", F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("from"), F.col("end")) < F.col("end"))
    return marked.where(is_base | ~covered).drop("upto", "from")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "*") -> DataFrame:
    """``doc_id, text`` with every character of a found span replaced."""
    marked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = find_personal_data(marked).dropDuplicates(["doc_id", "text_sha256"])
    text = F.aggregate(
        "spans",
        F.col("text"),
        lambda t, s: F.overlay(t, F.repeat(F.lit(mask), (s["end"] - s["start"]).cast("int")), s["start"] + 1, s["end"] - s["start"]),
    )
    same = marked["doc_id"].eqNullSafe(spans["doc_id"]) & (F.sha2(F.encode(marked["text"], "UTF-8"), 256) == spans["text_sha256"])
    return marked.join(spans, same).select(marked["doc_id"], text.alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data in every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_number_of(k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind_no"] <= len(BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
