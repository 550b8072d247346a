import zlib

import numpy as np
import pytest

from consensa.llm import quality_classifier as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = q.q_quality_classifier(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = (np.array([s for s, y in held if y == v]) for v in (1, 0))
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.97


def test_isotonic_against_least_squares_by_hand():
    at, level = q.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert np.allclose(level, [0, 1 / 3, 1]) and np.allclose(at, [1, 8 / 3, 4])


TEXTS = [None, "", " ", "word", "ä ö\n\nü", "x " * 5000, "word"]


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(3, 1), (5, 1), (3, None)], 1.0)])
def test_few_labels_and_edges(spark, labels, score):
    docs = spark.createDataFrame([(i if i != 4 else None, t, 9.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    rows = q.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), lambda c: c >= 0).collect()
    assert len(rows) == len(TEXTS) and all(abs(r.score - score) < 1e-6 for r in rows)


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert q.score(spark.createDataFrame([], "doc_id long, text string"), labels, lambda c: c >= 0).collect() == []
