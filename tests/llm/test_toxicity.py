"""Thresholds are chosen at the share of toxic rows that the table has."""

import random

import numpy as np
import pytest

from tonemill.llm import toxicity


def f1(toxic, said):
    return 2 * (toxic & said).sum() / max(toxic.sum() + said.sum(), 1)


@pytest.mark.parametrize("limits", [(60, 60), (10_000, 10_000)])
def test_thresholds_fit_the_whole_table(spark, monkeypatch, limits):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", limits[0])
    monkeypatch.setattr(toxicity, "MAX_CLEAN", limits[1])
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(6000):
        toxic = int(rng.random() < 0.05)
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(10))}" for _ in range(12)]
        words += ["vile"] * (rng.random() < (0.9 if toxic else 0.1)) + ["grim"] * (rng.random() < (0.8 if toxic else 0.02))
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    got = toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas().sort_values("doc_id")
    toxic, score = np.array([t for _, t in labels]) == 1, got["score"].to_numpy()
    best = max(f1(toxic, score >= t) for t in np.quantile(score, np.linspace(0.5, 1, 200)))
    assert f1(toxic, got["predicted"].to_numpy() == 1) > best - 0.03


def test_each_class_counts_as_often_as_it_stands():
    lang, toxic = np.zeros(4, int), np.array([0, 0, 1, 1])
    bins, n = np.array([0, 640, 640, 1280]), np.array([900, 100, 50, 50])
    strict = toxicity.calibrate(lang, bins, toxic, n, (9000, 0), 2)
    loose = toxicity.calibrate(lang, bins, toxic, n, (0, 9000), 2)
    assert 10 < strict[0] < 20 and 0 < loose[0] < 10 and strict[1] == strict[0]  # no row of a language: the common one


def test_thresholds_without_a_toxic_row_follow_the_share():
    """Nothing to calibrate on but clean rows: as many exceed the threshold as
    are toxic; a few rows of a language move its threshold little."""
    bins = np.arange(100) * 10
    alone = toxicity.calibrate(np.zeros(100, int), bins, np.zeros(100, int), np.ones(100), (0, 10), 1)
    share = 10 / 110
    assert abs((bins / toxicity.BINS > alone[0]).mean() - share) < 0.02
    lang = np.r_[np.zeros(200, int), 1, 1]
    bins, tox = np.r_[np.arange(100), np.arange(100) + 60, 5, 150] * 8, np.r_[np.zeros(100, int), np.ones(100, int), 1, 0]
    got = toxicity.calibrate(lang, bins, tox, np.ones(202), (0, 0), 2)
    assert abs(got[0] - got[1]) < 2


def model(seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) + " vile" * (i % 3 == 0) for i in range(120)]
    return toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(120)]), ["en" if i % 2 else "fr" for i in range(120)], epochs=3), texts


def naive(m, text):
    """Pooled answers by loops over words, offsets and filters."""
    words = [sum(m.table[r].astype(float) for r in toxicity.features_of(w)) for w in toxicity.words_of(text)]
    words += [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    out, at = [], 0
    for k in toxicity.WIDTHS:
        best = np.full(toxicity.FILTERS, -np.inf)
        for start in range(len(words) - max(toxicity.WIDTHS) + 1):
            best = np.maximum(best, sum(words[start + j] @ m.kernels[:, at + j * toxicity.FILTERS : at + (j + 1) * toxicity.FILTERS] for j in range(k)))
        out.append(best)
        at += k * toxicity.FILTERS
    return m.score(np.concatenate(out)[None].astype(np.float32))[0]


def test_a_score_is_a_function_of_its_text(spark):
    m, texts = model()
    texts = [*texts, "", "123 ...", "vile", "one", "good words here", "bad words here", " ".join(texts * 9)]
    want = np.array([naive(m, t) for t in texts])
    every = toxicity.Scorer(m)(texts)
    assert np.abs(every - want).max() < 1e-5
    assert np.abs(toxicity.Scorer(m)(texts[::-1])[::-1] - want).max() < 1e-5
    assert np.abs(np.array([toxicity.Scorer(m)([t])[0] for t in texts]) - want).max() < 1e-5
    encoder = toxicity.Scorer(m)
    encoder(texts)
    long = encoder.vocabulary.encode(toxicity.words_of(texts[-1]))
    for step in (7, 100, len(long) - 1, len(long), len(long) + 1):
        pooled = toxicity.pool(m, encoder.words, [encoder.vocabulary.encode(toxicity.words_of(t)) for t in texts], step)
        assert np.abs(m.score(pooled) - want).max() < 1e-5, step
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for parts in (1, 3, 7):
        got = {r["doc_id"]: r["s"] for r in toxicity.with_scores(df.repartition(parts), m, "s", chunk=5).collect()}
        assert np.abs(np.array([got[i] for i in range(len(texts))]) - want).max() < 1e-5


def separable(n, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 2
        text = " ".join(rng.choice(words) for _ in range(15)) + (" vile grim" if toxic else " kind calm")
        docs.append((i, text, "en", 0.25))
        labels.append((i, toxic, 1))
    return docs, labels


def test_forty_separable_rows(spark):
    docs, labels = separable(40, 2)
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(df, marks).collect()}
    assert sum(got[i] == t for i, t, _ in labels) >= 36
    kept = toxicity.filter_toxic(df, marks)
    assert kept.columns == df.columns and {r["score"] for r in kept.collect()} == {0.25} and 16 <= kept.count() <= 24


def test_held_out_quality(spark):
    """On documents whose labels were not learned from."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.scores(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    toxic, score = got["toxic"].to_numpy() == 1, got["score"].to_numpy()
    auc = (score[toxic][:, None] > score[~toxic][None]).mean()
    assert auc > 0.93 and got["predicted"].to_numpy()[~toxic].mean() < 0.05


def test_defined_cases(spark):
    docs, labels = separable(60, 4)
    docs += [(100, None, None, 1.0), (101, "", None, 1.0), (102, "123", None, 1.0), (None, "vile grim", "en", 1.0), (0, docs[0][1], "en", 1.0), (103, "kind " * 60_000 + "vile grim", "en", 1.0)]
    labels += [(100, 1, 1), (101, None, 1), (None, 1, 1), (7, 0, 1), (999, 1, 0)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.scores(df, marks).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[100] == by[101] == by[102] and by[103] > by[100]
    none = spark.createDataFrame([], marks.schema)
    assert {r["score"] for r in toxicity.scores(df, none).collect()} == {0.0}
    assert toxicity.scores(spark.createDataFrame([], df.schema), marks).count() == 0
    assert {r["score"] for r in toxicity.scores(df, marks.filter("toxic = 1")).collect()} == {1.0}
