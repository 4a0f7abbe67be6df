"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the table rows that the word itself and its
leading parts hash to, so that words of one stem share what is learned. Filters
of one, two and three words run over the whole text, from each of its words and
from one place after them; the largest answer of each filter feeds two heads,
one for toxicity and one for the language. Both are trained in numpy on a
bounded sample of labelled rows. A threshold on the toxicity logit is
calibrated for each language on all labelled rows that were not learned from:
Spark scores them and counts their logits in narrow bins. Each class counts
there as often as it stands in the table, though the sample takes more of the
rarer one, so thresholds don't move with the table's size. With few toxic rows
a language's threshold lies near the common one, and that near the level which
as many texts exceed as are toxic (see `calibrate`). A text is held against the
threshold of the language that the second head sees in it: neither labels nor
the lang column have a part in a score.

Scoring maps Arrow batches of documents; each holds one chunk of texts and a
bounded cache of word embeddings. A score is a function of the text alone.

Defined cases: null, empty and letterless texts get the score of a text without
words; rows without a label, with a null label or a null text aren't learned
from; a doc_id with several labels is toxic if one of them says so; a null
doc_id counts as the empty text; without a row of each label every score is the
share of toxic labels (0 if none); repeated rows each stay; an empty table gives
an empty result; very long texts are read whole; other columns are kept by
`filter_toxic`, whatever their names, and dropped by `scores`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, hashed_sample, materialize, small, trim

#: About so many labelled rows of each class are learned from, of texts up
#: to MAX_CHARS code points. All rows are scored, over their whole texts.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 4000, 20_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
PREFIXES = (4, 5, 7)
#: Small samples are gone through more often: LEAST_SEEN texts in all.
EPOCHS, LEAST_SEEN, BATCH, RATE, SEED = 3, 20_000, 64, 0.03, 7
#: Toxic rows that what is known without a language's own rows counts for.
PRIOR = 20.0
#: Bins of a logit's unit, and the largest logit told apart.
BINS, FAR = 64, 40
_WORD = re.compile(r"[^\W\d_]+")
CACHE = 100_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[int]:
    """Rows of the embedding table for a word and its leading parts."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    out += [zlib.crc32(b"<" + word[:n].encode()) % BUCKETS if len(word) >= n else out[0] for n in PREFIXES]
    return out


class Vocabulary:
    """Ids of words, from 1 on, and the table rows of each; 0 is no word."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self._rows = array("i", [0] * (1 + len(PREFIXES)))

    def __len__(self) -> int:
        return len(self.ids) + 1

    def encode(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids) + 1
            self._rows.extend(features_of(w))
        return np.array([ids[w] for w in words], dtype=np.int32)

    def rows(self, start: int = 0) -> np.ndarray:
        """Table rows of the words from id start on."""
        return np.array(self._rows[start * (1 + len(PREFIXES)) :], dtype=np.int32).reshape(-1, 1 + len(PREFIXES))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x DIM
    kernels: np.ndarray  # DIM x (sum of widths * FILTERS), by width, then offset
    bias: np.ndarray
    head: np.ndarray
    head_bias: float
    lang_head: np.ndarray
    lang_bias: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def conv(self, x: np.ndarray) -> np.ndarray:
        """Answers of all filters at each position of x (positions x DIM)."""
        y = x @ self.kernels
        outs, at = [], 0
        for k in WIDTHS:
            h = y[:, at : at + FILTERS].copy()
            for j in range(1, k):
                h[:-j] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            outs.append(h)
            at += k * FILTERS
        return np.concatenate(outs, axis=1)

    def heads(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.maximum(pooled + self.bias, 0)
        return z @ self.head + self.head_bias, z @ self.lang_head + self.lang_bias

    def bins(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language seen in each text, and the bin of its logit."""
        logit, lang = self.heads(pooled)
        return lang.argmax(1), np.floor(np.clip(logit, -FAR, FAR) * BINS).astype(np.int64)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        logit, lang = self.heads(pooled)
        shifted = logit - self.thresholds[lang.argmax(1)]
        return 1 / (1 + np.exp(-np.clip(shifted, -40, 40)))


def _joined(encoded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end with gaps of the widest filter, their starts, and
    the ends of the places from which filters may run: a text's own words and
    one gap, so that no filter reads on into the next text."""
    gap = np.zeros(max(WIDTHS), np.int32)
    lengths = np.array([len(e) for e in encoded])
    starts = np.concatenate([[0], np.cumsum(lengths + len(gap))[:-1]]).astype(np.int64)
    return np.concatenate([part for e in encoded for part in (e, gap)]), starts, starts + lengths + 1


def pool(model: Model, words: np.ndarray, encoded: list[np.ndarray], step: int = 50_000) -> np.ndarray:
    """Largest answer of each filter per text; words are embeddings by id."""
    out, i = np.empty((len(encoded), FILTERS * len(WIDTHS)), np.float32), 0
    while i < len(encoded):
        j, n = i, 0
        while j < len(encoded) and (j == i or n + len(encoded[j]) <= step):
            n += len(encoded[j])
            j += 1
        ids, starts, ends = _joined(encoded[i:j])
        if ends[0] > step:  # one long text, by parts: a filter may end behind the part it starts in
            out[i] = np.max([model.conv(words[ids[p : p + step + max(WIDTHS)]])[: min(step, ends[0] - p)].max(0) for p in range(0, ends[0], step)], axis=0)
        else:
            out[i:j] = np.maximum.reduceat(model.conv(words[ids]), np.stack([starts, ends], axis=1).ravel(), axis=0)[::2]
        i = j
    return out


def seed_embeddings(m: Model, buckets: list[np.ndarray], toxic: np.ndarray, lang: np.ndarray) -> None:
    """Start the first dimensions from how often a bucket's words stand in
    texts of a class, against what chance gives: toxic first, then each
    language. The first filters of each width read them. Without it, rare
    telling words seldom win a maximum and are learned too slowly."""
    classes = [toxic == 1] + [lang == k for k in range(min(len(m.langs), DIM - 2, FILTERS - 1))]
    total = np.bincount(np.concatenate(buckets), minlength=BUCKETS)
    for d, of in enumerate(classes):
        if not of.any():
            continue
        inside = np.bincount(np.concatenate([b for b, x in zip(buckets, of, strict=True) if x]), minlength=BUCKETS)
        expected = total * of.mean()
        m.table[:, d] += 0.15 * np.clip((inside - expected) / np.sqrt(expected + 1), -2, 6)
        at = 0
        for i, k in enumerate(WIDTHS):
            for _ in range(k):
                m.kernels[d, at + d] += 1 / k
                at += FILTERS
            if d == 0:
                m.head[i * FILTERS] += 1.0
            else:
                m.lang_head[i * FILTERS + d, d - 1] += 1.0


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None], epochs: int | None = None, seed: int = SEED) -> Model:
    epochs = max(EPOCHS, LEAST_SEEN // len(texts)) if epochs is None else epochs
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    encoded = [vocabulary.encode(words_of(t)) for t in texts]
    rows = vocabulary.rows()
    del vocabulary
    names = sorted({x for x in langs if x is not None}) or [""]
    lang = np.array([names.index(x) if x is not None else -1 for x in langs])
    n_out = FILTERS * len(WIDTHS)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = Model(names, f32(BUCKETS, DIM, scale=0.02), f32(DIM, sum(WIDTHS) * FILTERS, scale=0.1), np.zeros(n_out, np.float32), f32(n_out, scale=0.1), 0.0, f32(n_out, len(names), scale=0.1), np.zeros(len(names), np.float32))
    learn = np.arange(len(texts))
    seed_embeddings(m, [np.unique(rows[np.unique(encoded[i])]) for i in learn], toxic[learn], lang[learn])
    weight = np.where(toxic == 1, np.sqrt(max((toxic == 0).sum(), 1) / max((toxic == 1).sum(), 1)), 1.0)
    state = {k: np.full_like(getattr(m, k), 0.05) for k in ("table", "kernels", "bias", "head", "lang_head", "lang_bias")}
    head_state = 0.05

    def step(name: str, grad: np.ndarray, at=slice(None)) -> None:
        value, seen = getattr(m, name), state[name]
        seen[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(seen[at])

    for epoch in range(epochs):
        rate = RATE * (1 - epoch / (epochs + 1))
        order = rng.permutation(learn)
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            ids, starts, ends = _joined([encoded[i] for i in pick])
            used, local = np.unique(ids, return_inverse=True)
            words = m.table[rows[used]].sum(1)
            words[used == 0] = 0
            x = words[local]
            h = m.conv(x)
            best = np.stack([s + h[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
            pooled = np.take_along_axis(h, best, 0) + m.bias
            z = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(z @ m.head + m.head_bias, -40, 40)))
            d = ((p - toxic[pick]) * weight[pick] / len(pick)).astype(np.float32)
            q = z @ m.lang_head + m.lang_bias
            q = np.exp(q - q.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            known = lang[pick] >= 0
            q[np.flatnonzero(known), lang[pick][known]] -= 1
            q[~known] = 0
            q *= 0.3 / len(pick)
            dz = (d[:, None] * m.head + q @ m.lang_head.T) * (pooled > 0)
            step("head", z.T @ d)
            head_grad = float(d.sum())
            head_state += head_grad**2
            m.head_bias -= rate * head_grad / head_state**0.5
            step("lang_head", z.T @ q)
            step("lang_bias", q.sum(0))
            step("bias", dz.sum(0))
            dk, dw, at, col = np.zeros_like(m.kernels), np.zeros_like(words), 0, 0
            for k in WIDTHS:
                g, where = dz[:, col : col + FILTERS], best[:, col : col + FILTERS]
                for j in range(k):
                    inside = np.minimum(where + j, len(ids) - 1)
                    xs = x[inside]
                    dk[:, at : at + FILTERS] = np.einsum("bf,bfd->df", g, xs)
                    np.add.at(dw, local[inside].ravel(), (g[..., None] * m.kernels[:, at : at + FILTERS].T).reshape(-1, DIM))
                    at += FILTERS
                col += FILTERS
            step("kernels", dk)
            moved = np.flatnonzero((used != 0) & dw.any(1))
            if len(moved):
                flat = rows[used[moved]]
                touched, inverse = np.unique(flat, return_inverse=True)
                dt = np.zeros((len(touched), DIM), np.float32)
                np.add.at(dt, inverse.ravel(), np.repeat(dw[moved], flat.shape[1], axis=0))
                step("table", dt, touched)

    m.thresholds = np.zeros(len(names), np.float32)
    return m


def calibrate(lang: np.ndarray, bins: np.ndarray, toxic: np.ndarray, n: np.ndarray, learned: tuple[int, int], n_langs: int) -> np.ndarray:
    """The threshold of best F1 for each language, from the number n of rows of
    each language, bin and label. ``learned`` are the clean and toxic rows that
    aren't counted in n: each class is weighted up by them.

    To a language's rows those of all languages are added, scaled to PRIOR toxic
    rows; and to all those the same number of toxic rows and their share of
    clean ones as if the highest logits were the toxic ones. So little data moves
    a threshold little, and none at all leaves it where as many exceed it as are
    toxic."""
    x, at = np.unique(-bins, return_inverse=True)
    count = np.zeros((n_langs, 2, len(x)))
    for c in (0, 1):
        rows = n[toxic == c].sum()
        weight = (rows + learned[c]) / rows if rows else 0.0
        np.add.at(count, (lang[toxic == c], c, at[toxic == c]), n[toxic == c] * weight)

    def scaled(of: np.ndarray) -> np.ndarray:
        return of * (PRIOR / of[1].sum()) if of[1].sum() else of

    def best(of: np.ndarray) -> float:
        hit = of[1].cumsum()
        i = int((2 * hit / (of.sum(0).cumsum() + max(hit[-1], 1e-9))).argmax())
        # Halfway from the lower end of the last bin above to the upper end of the next one.
        return float(-x[i] + (1 - x[i + 1] if i + 1 < len(x) else -x[i])) / 2 / BINS

    both = count.sum((0, 1))
    rows = [count[:, c].sum() or learned[c] for c in (0, 1)]
    share = rows[1] / max(sum(rows), 1)
    top = np.clip(share * both.sum() - (both.cumsum() - both), 0, both)
    common = count.sum(0) + scaled(np.stack([both - top, top]))
    return np.array([best(c + scaled(common)) for c in count], np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def set_apart(doc_id: Column) -> Column:
    """A fifth of the sample, which isn't learned from either, so that there is
    something to calibrate on if the sample is all there is."""
    return F.pmod(F.xxhash64(F.lit(SEED + 1), doc_id), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model learned from rows that aren't held out, or the share of toxic
    labels if there is none of each class."""
    rows = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = materialize(rows.filter(~held_out(F.col("doc_id"))), "labelled")
    chosen = [hashed_sample(rows.filter(F.col("toxic") == c), n, SEED, "doc_id") for c, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    # At most twice MAX_TOXIC and MAX_CLEAN rows of two columns.
    ids = F.broadcast(materialize(chosen[0].unionByName(chosen[1]), "labelled-sample"))
    texts = docs.select("doc_id", "text", "lang").filter(F.length("text") <= MAX_CHARS).join(ids, "doc_id").select("text", "lang", "toxic", set_apart(F.col("doc_id")).alias("apart"))
    sample = texts.limit(4 * (MAX_TOXIC + MAX_CLEAN)).collect()
    toxic = np.array([int(r["toxic"] == 1) for r in sample])
    if not len(toxic) or toxic.all() or not toxic.any():
        return float(toxic.mean()) if len(toxic) else 0.0
    apart = {int(r["toxic"]) for r in sample if not r["apart"]} == {0, 1}
    if apart:  # else there are too few to keep any from learning
        sample = [r for r in sample if not r["apart"]]
    sample.sort(key=lambda r: zlib.crc32(r["text"].encode()))  # the same however rows arrive
    toxic = np.array([int(r["toxic"]) for r in sample])
    model = train([r["text"] for r in sample], toxic, [r["lang"] for r in sample])
    del sample
    trim()
    learned = ids.filter(~set_apart(F.col("doc_id"))) if apart else ids
    counts = logit_counts(docs, rows, learned.select("doc_id"), model)
    if len(counts):
        counted = (int((toxic == 0).sum()), int(toxic.sum()))
        model.thresholds = calibrate(*(counts[c].to_numpy() for c in ("seen", "bin", "toxic", "n")), counted, len(model.langs))
    return model


def logit_counts(docs: DataFrame, rows: DataFrame, learned: DataFrame, model: Model) -> pd.DataFrame:
    """seen, bin, toxic, n: how many labelled texts that weren't learned from
    fall in each bin; a bounded number of rows."""

    @F.pandas_udf("seen long, bin long")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            seen, bins = scorer.pooled(list(texts), model.bins) if len(texts) else ([], [])
            yield pd.DataFrame({"seen": seen, "bin": bins}, dtype="int64")
        del scorer
        trim()

    marks = rows.select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    marked = marks.join(F.broadcast(learned.withColumn("learned", F.lit(True))), "doc_id", "left")
    # Texts are scored after the join: moving a text costs far less than scoring it.
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(small(materialize(marked, "labels-learned")), "doc_id")
    kept = texts.filter(~(F.coalesce("learned", F.lit(False)) & (F.length("text") <= MAX_CHARS)))
    bins = kept.select("toxic", placed("text").alias("s"))
    counts = bins.groupBy("s.seen", "s.bin", "toxic").agg(F.count("*").alias("n"))
    return pd.DataFrame([r.asDict() for r in materialize(counts, "logit-counts").collect()], columns=["seen", "bin", "toxic", "n"])


class Scorer:
    """Scores texts; keeps the embeddings of up to CACHE words at hand."""

    def __init__(self, model: Model | float):
        self.model, self.vocabulary, self.words = model, Vocabulary(), np.zeros((1, DIM), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if isinstance(self.model, float):
            return np.full(len(texts), self.model)
        return self.pooled(texts, self.model.score).astype(float)

    def pooled(self, texts: list[str | None], of):
        """What the function ``of`` makes of the texts' pooled answers."""
        if len(self.vocabulary) > CACHE:
            self.vocabulary, self.words = Vocabulary(), self.words[:1]
        encoded = [self.vocabulary.encode(words_of(t)) for t in texts]
        fresh = self.vocabulary.rows(len(self.words))
        if len(fresh):
            self.words = np.concatenate([self.words, self.model.table[fresh].sum(1)])
        return of(pool(self.model, self.words, encoded))


def with_scores(docs: DataFrame, model: Model | float, name: str = "score", chunk: int = 200) -> DataFrame:
    """docs with the score as a column ``name``; all others pass through unread."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            parts = [scorer(list(texts.iloc[i : i + chunk])) for i in range(0, len(texts), chunk)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        del scorer
        trim()

    return docs.withColumn(name, score(F.col("text")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    # Written here, where batches are small.
    return materialize(scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), "toxicity")


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    name = fresh_name("score", docs)
    return materialize(with_scores(docs, fit(docs, labels), name).filter(F.col(name) < 0.5).select(*docs.columns), "toxicity-kept")
