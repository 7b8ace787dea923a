"""Every registered query of the library against its SQL, on the smallest tables."""

import pathlib
from collections import Counter

import duckdb
import pytest

from brightloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return plain(float(v)) if hasattr(v, "as_tuple") else v


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    got = oracle.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, got.fetchall())


def test_queries_without_sql_have_a_test_of_their_own():
    told = "".join(path.read_text() for path in pathlib.Path(__file__).parent.glob("test_*.py") if path.name != "test_catalog.py")
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert f"def test_{name}(" in told or f'QUERIES["{name}"]' in told, name


def test_no_pair_query_is_a_cartesian_product(spark):
    for name in ("post_text_dup", "near_dup_phash", "interval_align", "variant_collapse", "variant_bases", "weighted_duplicates", "crawl_rounds"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan
