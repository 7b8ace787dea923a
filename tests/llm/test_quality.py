import zlib

import numpy as np

from brightloom.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = Q.op10_quality(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]).all()
    assert ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_preferences_order_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, Q.N_FEATURES))
    label = (x[:, 3] - x[:, 5] + 0.1 * rng.normal(size=400) > 0).astype(int)
    model = Q.fit_pairwise(x, label)
    assert ((model.score(x) >= Q.THRESHOLD).astype(int) == label).mean() > 0.95
    assert 0.3 < model.quantile < 0.7
    one = Q.fit_pairwise(x, np.ones(400))
    assert (one.score(x) == Q.NO_PREFERENCE).all()


def test_features_of_odd_texts():
    for t in (None, b"", b" \n\t ", b"\xff\xfe", b"x" * 3_000_000, "ß!!".encode()):
        assert np.isfinite(Q.features(t)).all() and len(Q.features(t)) == Q.N_FEATURES


def test_nulls_repeats_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "some text", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = Q.with_quality(docs, labels).collect()
    assert len(rows) == 4 and {r.predicted for r in rows} == {1}
    assert Q.keep_good(docs, labels).columns == docs.columns
    assert Q.with_quality(docs.limit(0), labels).collect() == []
    assert Q.with_quality(docs, labels.limit(0)).count() == 4
