import random

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm.quality import features, fit, fit_quality, score_quality


def texts(seed, n):
    random.seed(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "st")]
    rows = []
    for i in range(n):
        w = random.choices(vocabulary, k=random.randint(5, 40))
        kind = i % 5
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1 and i % 2:
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w), int(not (kind == 0 or (kind == 1 and i % 2)))))
    return rows


def test_features_are_those_of_each_text_alone():
    some = ["", "ab", " ", "Ab cd!! cd!!", "é É", "a" * 50]
    raw = [t.encode() for t in some]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = features(np.frombuffer(b"".join(raw), np.uint8), offs)
    for r, ids in zip(raw, together, strict=True):
        alone = features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0]
        assert sorted(ids.tolist()) == sorted(alone.tolist())
        assert len(set(ids.tolist())) == len(ids)
    assert len(together[0]) == 0


def test_held_out_accuracy(spark):
    rows = texts(1, 500)
    df = spark.createDataFrame([(i, t, 7.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = fit_quality(df, labels.where(F.col("doc_id") % 5 != 4))
    got = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    right = [(got[i] >= 0.3) == q for i, _, q in rows]
    assert np.mean(right) >= 0.98
    again = fit_quality(df, labels.where(F.col("doc_id") % 5 != 4))
    assert np.array_equal(model.weights, again.weights)


def test_margins_satisfy_the_dual_optimum():
    rows, y = [np.array([1, 2]), np.array([2, 3]), np.array([1]), np.array([3])], np.array([1, 0, 1, 0])
    model = fit(rows, y)
    margins = [model.margin(r) for r in rows]
    assert min(margins[0], margins[2]) > max(margins[1], margins[3])
    assert all((model.score(r) >= 0.5) == bool(label) for r, label in zip(rows, y, strict=True))


def test_missing_labels_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (3, "word"), (None, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 7)], "doc_id long, quality int")
    got = score_quality(df, fit_quality(df, labels)).collect()
    assert len(got) == 5 and all(abs(r.score - 2 / 3) < 1e-9 for r in got)
    model = fit_quality(df, labels.limit(0))
    assert all(r.score == 0.5 for r in score_quality(df, model).collect())
    assert score_quality(df.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    rows = texts(2, 300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = fit_quality(df, labels, sample=60)
    scores = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    assert np.mean([(scores[i] >= 0.3) == q for i, _, q in rows]) >= 0.9
