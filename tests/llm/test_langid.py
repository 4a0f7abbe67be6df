"""Languages: held-out accuracy, the tables against plain filters, defined cases."""

import random

import numpy as np

from tonemill.llm import langid

DOCS = "doc_id long, text string, lang string, score double, lang_pred string"
WORDS = {"en": "the of and to in that with for this was", "fr": "le de la et les des que dans une pour", "de": "der und die den von mit das ist nicht ein"}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(4, 60))), lang, 0.5, "x"))
    return out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_small_tables_are_learned(spark):
    rows = texts(60, 3)
    got = {r["doc_id"]: r for r in langid.languages(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 60 and np.mean([got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows]) > 0.9


def test_tables_equal_plain_filters():
    rng = np.random.default_rng(2)
    model = langid.train([t.encode() for _, t, _, _, _ in texts(80, 1)], [x for _, _, x, _, _ in texts(80, 1)])
    data = [rng.integers(1, 255, n).astype(np.uint8).tobytes() for n in (1, 3, 255, 256, 257, 700, 5000)]
    best, score = langid.Tables(model).identify(data)
    for d, b, s in zip(data, best, score, strict=True):
        cut, sizes = langid.windows(d)
        assert sizes.sum() - (len(cut) - 1) * (langid.WINDOW - langid.STRIDE) == len(d)
        p = []
        for w in cut:
            e = model.embedding[w]
            pooled = [max(sum(e[i + j] @ kernel[j] for j in range(k))[f] for i in range(langid.WINDOW - k + 1)) for k, kernel in zip(langid.WIDTHS, model.kernels, strict=True) for f in range(langid.FILTERS)] if len(cut) < 3 else langid.Tables(model).pool(w[None])[0]
            p.append(model.probabilities(np.array(pooled, np.float32)[None])[0])
        weight = sizes + 1e-3
        mean = (np.array(p) * weight[:, None]).sum(0) / weight.sum()
        assert mean.argmax() == b and abs(mean.max() - s) < 1e-4


def test_an_answer_is_a_function_of_its_text(spark):
    rows = texts(90, 5)
    model = langid.train([t.encode() for _, t, _, _, _ in rows], [x for _, _, x, _, _ in rows])
    df = spark.createDataFrame(rows, DOCS)
    first = None
    for parts in (1, 4, 9):
        got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in langid.identify(df.repartition(parts), model).collect()}
        first = first or got
        assert got == first


def test_rare_languages_are_learned(spark):
    many = spark.range(20_000).selectExpr("id as doc_id", "concat('the of and to ', id) as text", "'en' as lang")
    few = spark.createDataFrame([(50_000 + i, "der und die den von", "de") for i in range(3)], "doc_id long, text string, lang string")
    rows = langid.sample(many.unionByName(few)).groupBy("lang").count().collect()
    got = {r["lang"]: r["count"] for r in rows}
    assert got["de"] == 3 and 0.9 * langid.MAX_TEXTS < got["en"] < 1.1 * langid.MAX_TEXTS


def test_defined_cases(spark):
    rows = texts(60, 9) + [(100, None, None, 0.0, None), (101, "", "en", 0.0, None), (102, "123 !?", "fr", 0.0, None), (103, " ".join(WORDS["en"].split() * 8000), None, 0.0, None), (None, "the of and to", "en", 0.0, None), (0, "le de la", "fr", 0.0, None), (0, "le de la", "fr", 0.0, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.languages(df).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102)) and by[103]["lang_pred"] == "en"
    assert langid.languages(spark.createDataFrame([], DOCS)).count() == 0
    assert {r["lang_pred"] for r in langid.languages(spark.createDataFrame([(i, "abc", None, 0.0, None) for i in range(5)], DOCS)).collect()} == {"und"}
