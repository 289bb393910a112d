import numpy as np

from llm.queries import op9_quality
from llm.ranker import FEATURES, bradley_terry, fit, scored, text_features


def test_weights_recover_an_order():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 3))
    truth = np.array([2.0, -1.0, 0.0])
    a, b = x[:2000], x[2000:]
    first = rnd.random(2000) < 1 / (1 + np.exp(-(a - b) @ truth))
    w = bradley_terry(np.where(first[:, None], a, b), np.where(first[:, None], b, a))
    assert np.allclose(w, truth, atol=0.25)


def test_odd_texts_have_defined_features(documents):
    odd = [None, "", " ", "a", "É", "x " * 50_000, "AB CD", "1 2 3", "|"]
    got = {r.id: r.features for r in text_features(documents(list(enumerate(odd)))).collect()}
    assert len(got) == len(odd) and all(len(f) == len(FEATURES) and np.isfinite(f).all() for f in got.values())
    at = {n: k for k, n in enumerate(FEATURES)}
    assert got[0] == got[1] and got[6][at["upper"]] == 0.8 and got[5][at["distinct_words"]] == 1 / 50_000
    assert got[8][at["bare_words"]] == 1.0 and got[4][at["high"]] == 1.0


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    for labels in ([(1, 1)], [(7, 0)], [(1, None)], []):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        scores = [r.score for r in scored(docs, table).collect()]
        assert len(scores) == 2 and scores[0] == scores[1] >= 0.3
    assert scored(documents([]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect() == []


def test_cut_is_the_quantile_over_all_labels_and_repeats_count_once(spark, documents):
    texts = [(i, "good words in a row " * (1 + i % 7) if i % 3 else f"x{i} !! || ## " * (1 + i % 5)) for i in range(600)]
    docs = documents(texts + [(1, "another text of the same id"), (None, "no id")])
    labels = [(i, int(i % 3 > 0)) for i in range(600)] + [(3, 0)] * 400 + [(None, 1), (5000, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    featured = text_features(docs)
    ranker = fit(featured, table, max_labelled=100)  # the sample is small, the cut is not
    assert len(set(ranker.weights)) > 1
    scores = {}
    for r in featured.select("id", "features", ranker.score().alias("score")).collect():
        if r.id is not None and (r.id not in scores or r.features < scores[r.id][0]):
            scores[r.id] = (r.features, r.score)
    raw = [float(np.log(s / (1 - s))) for _, s in scores.values()]
    assert abs(np.quantile(raw, 1 / 3) - np.log(0.3 / 0.7)) < 1e-6
    plain = featured.where("id = 7").first().features
    want = 1 / (1 + np.exp(-(np.dot(plain, ranker.weights) + ranker.shift)))
    assert abs(scores[7][1] - want) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and len(labels) > 40
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) >= 0.93
    assert all(0 <= r.score <= 1 for r in got.values())
