"""N-grams counted on Arrow columns against plain counting."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.operators import vectors

TEXTS = ["red fox red fox", None, "Red dog", "", "fox", "Éa été dog dog dog", "x red"]


def grams(words, sizes=(1, 2)):
    return [" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
def test_counts_equal_the_tokens(spark, sizes):
    df = spark.createDataFrame([(i, t, None if i % 3 == 0 else i % 3) for i, t in enumerate(TEXTS * 3)], "k long, t string, fold int").repartition(2)
    tokens = vectors.tokenize(df, "t", ["k", "fold"], sizes)
    for by in ([], ["fold"]):
        want = tokens.groupBy(*by, "term").agg(F.count("*").alias("tf"), F.countDistinct("k").alias("df"))
        got = vectors.term_counts(df, "t", sizes, by)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        # Nothing is exploded row by row.
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_slices_of_texts_add_up(monkeypatch, most):
    monkeypatch.setattr(vectors, "SLICE_WORDS", most)
    lists = [["a", "b", "a"], [], None, ["b"], ["a"] * 5, ["b", "a"]]
    column = pa.array([["z"], *lists], pa.list_(pa.string())).slice(1)
    tf, df = Counter(), Counter()
    for batch in vectors._term_sums([pa.record_batch([column], ["w"])], (1, 2), 0):
        for r in batch.to_pylist():
            tf[r["term"]] += r["tf"]
            df[r["term"]] += r["df"]
    found = [grams(x or []) for x in lists]
    assert tf == Counter(g for x in found for g in x) and df == Counter(g for x in found for g in set(x))
    block = vectors.TextBlock(["a", "a a", "b a"], vectors.np.ones(3), False, (1, 2))
    places = [(int(r), int(p), float(n)) for x in block.counts(column) for r, p, n in zip(*x)]
    assert places == [(i, p, float(x.count(t))) for i, x in enumerate(found) for p, t in enumerate(block.terms) if t in x]


ODD = ["", "a", "ab", "A_b c9 ½x", "naïve-été ǅx 𝐀𝐁 x", "日本語 テキスト", "١٢ ok.ok", "x́y zz", "😀ab😀", "two\x00words", "ends_", "İstanbul ΣΑΣ"]


def test_words_of_texts_as_numbers(spark):
    texts = ODD + [a + " " + b for a in ODD for b in ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").repartition(3)
    want = vectors.tokenize(df, "t", ["k"]).groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("k").alias("df"))
    got = vectors.term_counts(df, "t", (1, 2))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # No list of words is made row by row.
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("most", [1, 2, 1 << 20])
def test_slices_of_plain_texts(monkeypatch, most):
    monkeypatch.setattr(vectors, "SLICE_WORDS", most)
    texts = ["zz", "aa bb aa", "", "x", "bb", "aa " * 5, "éé aa"]
    found = [(lo + int(r), w) for lo, words, row in vectors._word_slices(pa.array(texts).slice(1)) for w, r in zip(words.to_pylist(), row)]
    assert found == [(i, w) for i, t in enumerate(texts[1:]) for w in t.split() if len(w) > 1]
    block = vectors.TextBlock(["aa", "aa aa", "bb aa", "no", "no aa"], vectors.np.ones(5), False, (1, 2))
    places = [(int(r), int(p), float(n)) for x in block.counts(pa.array(texts)) for r, p, n in zip(*x)]
    lists = [grams([w for w in t.split() if len(w) > 1]) for t in texts]
    assert places == [(i, p, float(x.count(t))) for i, x in enumerate(lists) for p, t in enumerate(block.terms) if t in x]


def test_counts_of_keys_too_large_for_one_number():
    key, row = vectors.np.array([5, 1 << 61, 5, 5]), vectors.np.array([0, 7, 0, 3])
    for most in (1 << 62, 6):
        kept = key < most
        found = vectors._counted(key[kept], row[kept], most)
        assert [list(map(int, x)) for x in found] == ([[5, 1 << 61], [3, 1], [2, 1]] if most > 6 else [[5], [3], [2]])


@pytest.mark.parametrize("bits,proposed", [(18, 2), (12, 1), (3, 1)])
def test_vocabulary_counts_only_terms_that_may_be_frequent(spark, monkeypatch, bits, proposed):
    monkeypatch.setattr(vectors, "SLOT_BITS", bits)
    monkeypatch.setattr(vectors, "PROPOSED", proposed)
    # "all" is in too many rows, "once" in too few; rare words follow.
    texts = [" ".join(["all", *[f"w{j}" for j in range(2, 40) if i % j == 0], f"rare{i} rarer{i}"]) for i in range(400)] + ["once " * 500, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for sizes in ((1, 2), (1, 1), (2, 3)):
        params, tf, rows = vectors.TextParams(max_features=12, ngrams=sizes), Counter(), Counter()
        for t in texts:
            found = grams((t or "").split(), sizes)
            tf.update(found)
            rows.update(set(found))
        kept = [w for w in tf if 2 <= rows[w] <= 0.9 * len(texts)]
        want = sorted(sorted(kept, key=lambda w: (-tf[w], w))[:12])
        got = vectors.fit_tfidf(df, "t", params).orderBy("idx").collect()
        assert [(r.term, r.tf, r.df) for r in got] == [(w, tf[w], rows[w]) for w in want]
        if bits > 3:
            open_ = vectors._open_slots(df, "t", params, len(texts))
            assert vectors.term_counts(df, "t", sizes, open_=open_).count() < len(tf) / 4
