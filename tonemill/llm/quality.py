"""Quality: a compression classifier.

Two zstandard dictionaries hold text that is labelled good and text that is
labelled bad. A text is cut into pieces of PIECE bytes of UTF-8, each is
compressed with either dictionary, and the sum over all pieces of what the bad
one takes more than the good one, per byte of the text, is its difference:
pieces are short, so that a long text is held against the dictionaries and not
against itself. A logistic curve makes the difference a probability. It is fitted
to the sampled texts, each measured by dictionaries without its quarter of the
sample, and weighted by how many labels there are of each kind.

Dictionaries come from a bounded sample of labelled rows (MAX_TEXTS of each
label, SNIPPET characters at a hashed place of each); both get as many bytes.
All rows are scored, over their whole texts, in batches of bounded size.

Defined cases: null and empty texts have difference 0 and the score that makes;
labels other than 0 and 1, null ids, and documents labelled both ways aren't
learned from, repeated labels count once; without labelled texts of both kinds
every score is the share of label 1, 0.5 if there is no label at all; very long
texts are read whole, piece by piece; repeated rows each stay; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialize, trim

MAX_TEXTS = 1500
#: Characters taken of a text, least bytes of it in a dictionary, and a dictionary's.
SNIPPET, LEAST, DICTIONARY = 4000, 1000, 1 << 20
PIECE, LEVEL, FOLDS, SEED = 1000, 9, 4, 23


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 1.0
    offset: float = 0.0

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -500, 500)))


def dictionaries(good: list[bytes], bad: list[bytes]) -> Model:
    """Of equal size, shared evenly by the texts of each."""
    size = min(DICTIONARY, sum(map(len, good)), sum(map(len, bad)))

    def joined(texts: list[bytes]) -> bytes:
        part = max(LEAST, size // max(len(texts), 1) + 1)
        return b"\n".join(t[:part] for t in texts)[:size]

    return Model(joined(good), joined(bad))


class Meter:
    """Differences of texts; holds two compressors."""

    def __init__(self, model: Model):
        self.by = [self._compressor(d) for d in (model.bad, model.good)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str | None) -> float:
        data = memoryview((text or "").encode())
        bad, good = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.by)
        return (bad - good) / len(data) if len(data) else 0.0


def calibrate(difference: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of greatest likelihood, by Newton's
    steps on standardised differences; labels are drawn in by a row's worth of
    each, which keeps both finite where the classes don't overlap."""
    mean, scale = float(np.average(difference, weights=weight)), float(difference.std()) or 1.0
    x = np.stack([(difference - mean) / scale, np.ones(len(difference))], 1)
    n = np.array([weight[label == 0].sum(), weight[label == 1].sum()])
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    at = np.array([0.0, math.log((n[1] + 1) / (n[0] + 1))])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (target - p)))
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-12:
            step /= 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return at[0] / scale, at[1] - at[0] * mean / scale


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model learned from rows that aren't held out, or the share of label 1
    if there aren't texts of both."""
    rows = labels.select("doc_id", "quality").filter("quality in (0, 1) and doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    rows = materialize(rows.filter(~held_out(F.col("doc_id"))), "quality-labels")
    count = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    if len(count) < 2:
        return share
    chosen = [hashed_sample(rows.filter(F.col("quality") == q), MAX_TEXTS, SEED, "doc_id") for q in (0, 1)]
    # At most twice 2 * MAX_TEXTS rows of two columns.
    ids = F.broadcast(materialize(chosen[0].unionByName(chosen[1]), "quality-sample"))
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int")
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0).join(ids, "doc_id").select("quality", "text", fold.alias("fold"), F.xxhash64("doc_id", "text").alias("h"))
    place = (F.pmod("h", F.greatest(F.length("text") - SNIPPET + 1, F.lit(1))) + 1).cast("int")
    cut = texts.select("quality", "fold", "h", F.substr("text", place, F.lit(SNIPPET)).alias("cut")).limit(8 * MAX_TEXTS).collect()
    if {r["quality"] for r in cut} != {0, 1}:
        return share
    cut.sort(key=lambda r: (r["h"], r["cut"]))  # the same however rows arrive

    def without(fold: int | None) -> Model:
        return dictionaries(*([r["cut"].encode() for r in cut if r["quality"] == q and r["fold"] != fold] for q in (1, 0)))

    models = [without(f) for f in range(FOLDS)]
    measured = with_difference(texts, models, "difference", F.col("fold")).select("quality", "difference")
    seen = measured.limit(8 * MAX_TEXTS).toPandas()
    label = seen["quality"].to_numpy()
    have = np.bincount(label, minlength=2)
    # As many rows as there are differences, in the proportion of all labels.
    weight = np.array([count[q] / max(have[q], 1) for q in (0, 1)]) * len(label) / sum(count.values())
    model = without(None)
    model.slope, model.offset = calibrate(seen["difference"].to_numpy(), label, weight[label])
    return model


def with_difference(docs: DataFrame, models: list[Model], name: str, which: Column | None = None) -> DataFrame:
    """docs with the normalised difference of compressed sizes as ``name``, by
    the model whose index ``which`` holds."""

    @F.pandas_udf("double")
    def difference(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        meters = [Meter(m) for m in models]
        for texts, at in batches:
            yield pd.Series([meters[i](t) for t, i in zip(texts, at, strict=True)], dtype="float64")
        del meters
        trim()

    return docs.withColumn(name, difference(F.col("text"), F.lit(0) if which is None else which))


def with_scores(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """docs with the calibrated score as a column ``name``; all others pass through unread."""
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    scored = with_difference(docs, [model], name)
    return scored.withColumn(name, 1 / (1 + F.exp(-F.least(F.greatest(F.col(name) * model.slope + model.offset, F.lit(-500.0)), F.lit(500.0)))))


def scores(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= least) for each document."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    # Written here, where batches are small.
    return materialize(scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")), "quality")
