"""Answers of a model as columns, whole and broken."""

from pyspark.sql import functions as F

from brightloom.operators import entities as E


def test_answers(spark):
    answers = [
        (1, '{"brand": {"name": " acme®  motors "}, "promotion": "Summer   Days", "prices": [{"currency": "usd", "amount": 1234.5}, {"amount": 0}, {"currency": "JPY", "amount": 5}], "offers": [{"value": "", "type": "lease"}, {"value": "10% off"}, {}]}'),
        (2, 'Sure: {"brand": {"name": "GLOBEX"}, "promotion": "None", "financing": {"monthly": 199, "months": 36, "apr": 3.90}, "evidence": [{"text": "seen", "confidence": 0.4}, {"reason": "said", "confidence": 0.9}, {"text": " "'),
        (3, '{"brand": {"name": "®"}, "financing": {"currency": "EUR", "monthly": 10, "months": 0}, "offers": null}'),
        (4, "nothing"),
        (5, None),
        (6, '{"financing": {"months": 12}}'),
    ]
    table = spark.createDataFrame(answers, "id long, said string")
    aliases = spark.createDataFrame([("globex", "Globex Corp")], "name string, brand string")
    got = {r.id: tuple(r)[1:] for r in E.mapped(table, "id", "said", aliases).collect()}
    assert got[1] == ("Acme Motors", "Summer Days", ["$1,234.50", "JPY 5.00"], ["lease", "10% off"], [], None)
    assert got[2] == ("Globex Corp", None, [], ["$199.00/mo 36-mo 3.9% APR"], ["seen", "said"], 0.9)
    assert got[3] == (None, None, [], ["€10.00/mo"], [], None)
    assert got[4] == got[5] == got[6] == (None, None, [], [], [], None)


def test_labels(spark):
    rows = spark.createDataFrame([("GBP", 5.0), (None, 1e6), ("kr", 2.345), ("USD", None)], "c string, a double")
    assert [r.x for r in rows.select(E.price_label(F.col("c"), F.col("a")).alias("x")).collect()][:2] == ["£5.00", "$1,000,000.00"]
