"""Quality: held-out labels, a plain meter, the curve, defined cases."""

import random

import numpy as np
import zstandard

from tonemill.llm import quality

DOCS = "doc_id long, text string, score string, quality string"
GOOD = "the river ran below a quiet town where people walked and talked in the evening".split()


def text_of(rng, good):
    words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 120))]
    return " ".join(words if good else [w.upper() + "!!" for w in words])


def rows_of(n, seed):
    rng = random.Random(seed)
    kinds = [int(rng.random() < 0.7) for _ in range(n)]
    return [(i, text_of(rng, k), "x", "y") for i, k in enumerate(kinds)], [(i, k) for i, k in enumerate(kinds)]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert len(bad) > 50 and (good[:, None] > bad).mean() > 0.98
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all() and (got["predicted"] == got["quality"]).mean() > 0.95
    # Calibrated: as many are good as the scores say.
    assert abs(got["score"].mean() - got["quality"].mean()) < 0.03


def test_the_meter_sums_all_pieces():
    model = quality.dictionaries([b"good words in a row " * 30], [b"BAD!! WORDS!! " * 60])
    assert len(model.good) == len(model.bad)
    text = "good words in a row, " * 200 + "é" * 700
    data, sizes = text.encode(), []
    for content in (model.bad, model.good):
        total = 0
        for i in range(0, len(data), quality.PIECE):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(data[i : i + quality.PIECE]))
        sizes.append(total)
    got = quality.Meter(model)(text)
    assert abs(got - (sizes[0] - sizes[1]) / len(data)) < 1e-2 and got > 0
    assert quality.Meter(model)("BAD!! WORDS!! " * 40) < 0 and quality.Meter(model)("") == quality.Meter(model)(None) == 0.0


def test_the_curve_follows_frequencies():
    rng = np.random.default_rng(4)
    x = rng.normal(size=20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(3 * x + 1)))).astype(int)
    slope, offset = quality.calibrate(x / 50, label, np.ones(len(x)))
    assert abs(slope / 50 - 3) < 0.2 and abs(offset - 1) < 0.1
    slope, offset = quality.calibrate(np.array([-1.0, -0.9, 0.9, 1.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert np.isfinite([slope, offset]).all() and slope > 0


def test_defined_cases(spark):
    rows, labels = rows_of(120, 1)
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "quiet town", None, None), (1002, text_of(random.Random(9), 1) * 2000, None, None), (1002, "twice", None, None)]
    labels += [(None, 1), (1001, 0), (3, 5), (4, None), (5, 0), (5, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.scores(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1000] == by[1001]
    right = [(by[i] >= 0.7) == bool(k) for i, k in rows_of(120, 1)[1] if i not in (3, 4, 5)]
    assert np.mean(right) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.scores(docs.repartition(7), marks).collect()}
    assert all(abs(again[i] - by[i]) < 1e-9 for i in by if i not in (1002,))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(rows_of(5, 2)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    assert {r["score"] for r in quality.scores(docs, ones).collect()} == {1.0}
    assert quality.scores(docs.limit(0), ones).collect() == []
