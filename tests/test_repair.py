"""Repair of recognised text, counts of ratings, names of products."""

from pyspark.sql import functions as F

from brightloom.functions import repair as R
from brightloom.queries import review


def told(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r.x for r in rows.select("n", f(F.col("t")).alias("x")).orderBy("n").collect()]


def test_rules_in_order(spark):
    cases = {
        "20％ off": "20% off", "$12.500 and $1.2345": "$12,500 and $1.2345", "belowmsrp rebat": "BELOW MSRP REBATE", "Military&FirstResponder": "MILITARY & FIRST RESPONDER", "CALL8005551234": "CALL 8005551234",
        "60MOS": "60 MOS", "ends.Now at 5.Then  \n x": "ends. Now at 5. Then x", "3.9% APRfinancing": "3.9% APR financing", None: None, "": "", "recall5": "recall5",
    }
    assert told(spark, R.ocr_repaired, list(cases)) == list(cases.values())


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.tsv").write_text("# pattern, replacement, case\nc0lour\tcolour\tany\n\n(a+)b\t<$1>\tsame\nx\n")
    rules = R.read_rules(spark, str(tmp_path / "rules.tsv"))
    assert rules == [("c0lour", "colour", False), ("(a+)b", "<$1>", True), ("x", "", True)]
    assert told(spark, lambda c: R.apply_rules(c, rules), ["C0LOUR aab AAB x"]) == ["colour <aa> AAB "]


def test_counts_of_ratings(spark):
    cases = {
        "1,234 ratings": 1234, "(1.2K)": 1200, "3 M": 3_000_000, "3.5m reviews": 3_500_000, "12 thousand": 12_000, "12 members": 12, "no ratings": None, "": None, None: None, "10000000": 10_000_000,
        "10,000,001": None, "11 million": None, "4.6 stars": 4, "99999999999999999999999": None, "1.0015K": 1001,
    }
    assert told(spark, R.rating_count, list(cases)) == list(cases.values())


def products(spark, *rows, makes=("ford", "jeep")):
    table = spark.createDataFrame([(i, list(p) if p is not None else None, b) for i, (p, b) in enumerate(rows)], "id int, p array<string>, b string")
    return {r.id: r.products for r in R.repaired_products(table, "id", F.col("p"), F.col("b"), list(makes)).collect()}


def test_products(spark):
    got = products(
        spark,
        (["20GX4 Bronco Sport", "Ford Bronco Sport ,", "2024 FORD F-150 LE AWD", "bronco-sport", "x", "Ford"], "Ford"),
        (["Ford", "Mustang"], "Acme"),
        (["Ford", "Mustang 5"], "Acme"),
        (["ANDWRANGLER", "Jeep  Jeep"], "Jeep"),
        (["2024 Jeep", "2025"], "Jeep"),
        ([], "Jeep"),
        (None, None),
        (["Grand .Tour", None], None),
    )
    assert got == {0: ["Bronco Sport", "2024 F-150 LE AWD"], 1: ["Ford", "Mustang"], 2: ["Mustang 5"], 4: ["2024 Jeep", "2025"], 7: ["Grand.Tour"]}


def test_products_are_repaired_once(spark):
    rows = spark.createDataFrame([(1, "Acme", ["Acme bolt ,", "2024 RED GEAR AWD"])], "id long, brand string, said array<string>")
    found = R.repaired_products(rows, "id", F.col("said"), F.col("brand"), ["gear"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "BELOW MSRP" not in plan and plan.count("regexp_replace") < 20
    assert [r.products for r in found.collect()] == [["bolt", "2024 Red Gear AWD"]]


def test_terms_share_one_repair_of_their_text(spark):
    plan = review.financing_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == len(R.OCR_RULES)
