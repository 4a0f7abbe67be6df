"""Language identification: a byte convolutional network.

Lower-cased texts are cut into windows of WINDOW bytes of UTF-8 that overlap by
the widest filter less one, so that all bytes are seen. In a window, filters of several
widths run over the bytes, each keeps its largest answer, and a softmax gives
the languages; a text's probabilities are the mean of its windows', weighted
by their bytes. The network is trained in numpy on windows of a bounded sample
of labelled texts.

When applied, a filter's weights are tables by byte and by pair of bytes, so
an answer is two or three rows added up, over blocks of windows of fixed size.

Defined cases: null texts and texts without a letter are `und` with score 0;
rows of null lang or text aren't learned from; a null doc_id counts as the
empty text; if nothing can be learned, all texts are `und`; invalid surrogates
can't occur, as Spark holds UTF-8; an empty table gives an empty result; very
long texts are read whole; repeated rows each stay; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: About so many texts are learned from, and about LEAST_TEXTS of each language
#: (all, if it has fewer), SAMPLES windows from each, taken at hashed places. All
#: rows are identified, over their whole texts.
MAX_TEXTS, LEAST_TEXTS, SAMPLES = 6000, 200, 3
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE, SEED = 2, 64, 0.05, 5
STRIDE = WINDOW - max(WIDTHS) + 1
_BLOCK = 512


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray  # 256 x DIM
    kernels: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        q = np.maximum(pooled + self.bias, 0) @ self.head + self.head_bias
        q = np.exp(q - q.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def windows(data: bytes, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of data, padded by 0 bytes, and their true sizes."""
    n = max(1, -(-(len(data) - (window - stride)) // stride))
    padded = np.zeros((n - 1) * stride + window, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(padded, window)[::stride]
    return cut, np.minimum(len(data) - np.arange(n) * stride, window)


class Tables:
    """Filters as sums of rows by byte or by pair of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.parts: list[list[tuple[int, bool, np.ndarray]]] = []
        for kernel in model.kernels:
            by_byte = [model.embedding @ k for k in kernel]
            parts, j = [], 0
            while j < len(by_byte):
                if j + 1 < len(by_byte):
                    pair = by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]
                    parts.append((j, True, np.ascontiguousarray(pair.reshape(65536, -1), np.float32)))
                else:
                    parts.append((j, False, np.ascontiguousarray(by_byte[j], np.float32)))
                j += 2
            self.parts.append(parts)

    def pool(self, cut: np.ndarray) -> np.ndarray:
        """Largest answers of all filters for each window."""
        out = np.empty((len(cut), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(cut), _BLOCK):
            block = cut[at : at + _BLOCK]
            pairs = block[:, :-1].astype(np.int32) * 256 + block[:, 1:]
            for i, (width, parts) in enumerate(zip(WIDTHS, self.parts, strict=True)):
                n = block.shape[1] - width + 1
                total = None
                for j, paired, rows in parts:
                    got = rows.take((pairs if paired else block)[:, j : j + n], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                out[at : at + len(block), i * FILTERS : (i + 1) * FILTERS] = total.max(1)
        return out

    def identify(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its mean probability) for each text; texts
        are gathered to about as many windows as are pooled at once."""
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        i = 0
        while i < len(texts):
            cuts, sizes, owner = [], [], []
            while i < len(texts) and sum(map(len, cuts)) < 4 * _BLOCK:
                c, s = windows(texts[i])
                cuts.append(c)
                sizes.append(s)
                owner.append(np.full(len(c), i))
                i += 1
            weight, who = np.concatenate(sizes) + 1e-3, np.concatenate(owner)
            p = np.concatenate([self.model.probabilities(self.pool(c)) for c in _grouped(cuts)]) * weight[:, None]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            mean = np.add.reduceat(p, starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
            best[who[starts]], score[who[starts]] = mean.argmax(1), mean.max(1)
        return best, score


def _grouped(cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Short texts' windows in one array; a very long text's stay a view."""
    out: list[np.ndarray] = []
    small: list[np.ndarray] = []
    for c in cuts:
        if len(c) > 4 * _BLOCK:
            out += [np.concatenate(small)] if small else []
            out.append(c)
            small = []
        else:
            small.append(c)
    return out + ([np.concatenate(small)] if small else [])


def train(samples: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Learn from byte strings of up to WINDOW bytes."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    share = np.bincount(y) / len(y)
    weight = (1 / share / len(names))[y] ** 0.5
    x_all = np.zeros((len(samples), WINDOW), np.uint8)
    for i, s in enumerate(samples):
        s = s[:WINDOW]
        if i % 4 == 0 and len(s) > 12:  # short texts, too
            s = s[: int(rng.integers(8, len(s)))]
        x_all[i, : len(s)] = np.frombuffer(s, np.uint8)
    n_out = FILTERS * len(WIDTHS)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"embedding": f32(256, DIM, scale=0.5), "bias": np.zeros(n_out, np.float32), "head": f32(n_out, len(names), scale=0.2), "head_bias": np.zeros(len(names), np.float32)}
    p |= {f"k{k}": f32(k, DIM, FILTERS, scale=0.3) for k in WIDTHS}
    state = {k: np.full_like(v, 0.05) for k, v in p.items()}
    at = np.arange(BATCH)[:, None]
    for epoch in range(max(epochs, 12_000 // max(len(samples), 1))):
        order = rng.permutation(len(samples))
        for b in range(0, len(order) - BATCH + 1 if len(order) >= BATCH else 1, BATCH):
            pick = order[b : b + BATCH]
            rows = at[: len(pick)]
            data = x_all[pick]
            e = p["embedding"][data]
            pooled, where = [], []
            for k in WIDTHS:
                n = WINDOW - k + 1
                h = sum(e[:, j : j + n] @ p[f"k{k}"][j] for j in range(k))
                w = h.argmax(1)
                where.append(w)
                pooled.append(np.take_along_axis(h, w[:, None, :], 1)[:, 0])
            a = np.concatenate(pooled, 1) + p["bias"]
            z = np.maximum(a, 0)
            q = z @ p["head"] + p["head_bias"]
            q = np.exp(q - q.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(pick)), y[pick]] -= 1
            q *= (weight[pick] / len(pick))[:, None]
            dz = (q @ p["head"].T) * (a > 0)
            grads = {"head": z.T @ q, "head_bias": q.sum(0), "bias": dz.sum(0), "embedding": np.zeros_like(p["embedding"])}
            for i, k in enumerate(WIDTHS):
                g, dk = dz[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(p[f"k{k}"])
                for j in range(k):
                    took = where[i] + j
                    dk[j] = np.einsum("bf,bfd->df", g, e[rows, took])
                    np.add.at(grads["embedding"], data[rows, took].ravel(), (g[..., None] * p[f"k{k}"][j].T).reshape(-1, DIM))
                grads[f"k{k}"] = dk
            for name, grad in grads.items():
                state[name] += grad * grad
                p[name] -= (RATE / (1 + epoch)) * grad / np.sqrt(state[name])
    return Model(names, p["embedding"], [p[f"k{k}"] for k in WIDTHS], p["bias"], p["head"], p["head_bias"])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(known: DataFrame) -> DataFrame:
    """Rows chosen by a hash of doc_id: each language's share of MAX_TEXTS, and
    no fewer than about LEAST_TEXTS of it, so that rare ones are learned, too.
    Repeats of a row are chosen alike; a limit bounds what they add."""
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("_n")), "language-sizes")
    total, langs = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    if total <= MAX_TEXTS:
        return known
    rate = F.greatest(F.lit(MAX_TEXTS / total), F.least(LEAST_TEXTS / F.col("_n"), F.lit(1.0)))
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) < rate * float(1 << 40)
    return known.join(small(sizes), "lang").filter(chosen).drop("_n").limit(2 * (MAX_TEXTS + LEAST_TEXTS * langs))


def fit(docs: DataFrame) -> Model | None:
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    known = sample(known).filter(F.col("text").rlike("\\p{L}")).withColumn("_h", F.xxhash64("doc_id", "text"))
    place = lambda i: (F.pmod(F.xxhash64("_h", F.lit(i)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1).cast("int")
    cut = F.array(*[F.col("text").substr(place(i), F.lit(WINDOW)) for i in range(SAMPLES)])
    rows = sorted(known.select("lang", "_h", cut.alias("cut")).collect(), key=lambda r: (r["_h"], r["lang"]))
    pairs = [(c.lower().encode()[:WINDOW], r["lang"]) for r in rows for c in r["cut"]]
    return train([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = Tables(model) if model else None
        for texts in batches:
            out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
            ask = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if tables else []
            if ask:
                best, score = tables.identify([texts.iloc[i].lower().encode() for i in ask])
                out.loc[ask, "lang_pred"] = [model.langs[b] for b in best]
                out.loc[ask, "score"] = np.minimum(score, 1.0)
            yield out

    found = docs.drop("lang_pred", "score").withColumn("_found", predict(F.col("text")))
    return found.select("*", "_found.lang_pred", "_found.score").drop("_found")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    # Written here, where batches are small.
    return materialize(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"), "languages")
