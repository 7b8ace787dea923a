"""Tables in the shared folder."""

from pyspark.sql import functions as F

from brightloom.plans.shared import CLEANUP, SETTING, Scratch, shared_dir


def test_a_session_without_the_folder_gets_one(spark):
    if not spark.conf.get(SETTING, None):
        assert shared_dir(spark).startswith("file://") and shared_dir(spark) == shared_dir(spark)
    kept = Scratch(spark, "test").keep(spark.range(5), "five")
    assert kept.count() == 5


def test_tables_are_replaced_and_dropped(spark):
    scratch, before = Scratch(spark, "test"), spark.conf.get(CLEANUP)
    scratch.keep(spark.range(5), "a")
    first = scratch.paths["a"]
    b = scratch.keep(scratch.keep(spark.range(7), "a").groupBy((F.col("id") % 2).alias("k")).count(), "b")
    assert scratch.paths["a"] != first and spark.conf.get(CLEANUP) == before
    scratch.drop_all_but("b")
    assert set(scratch.paths) == {"b"} and b.count() == 2
