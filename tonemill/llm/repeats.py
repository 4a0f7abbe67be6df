"""Suffix-array dedup: repeated strings of bytes across documents.

A byte is removed if a string of LENGTH bytes over it also starts in a document
of smaller doc_id. All suffixes of a corpus are far more than the corpus, so
the array is sparse: of each LENGTH-byte window only the suffix at its
minimizer is kept, the leading KMER bytes of which hash least in the window.
Equal windows keep the same suffix at the same offset, so no repeat is lost,
while one suffix in about fourteen is stored.

1. Sampled splitters over the suffixes' leading tokens cut them into buckets. A
   token that fills several buckets by itself is dealt over those by document.
   In each bucket suffixes are sorted by their KMER bytes' hash, and those that
   no second document has are left out. There are as many buckets as keep each
   one's suffixes in a task's memory, whatever the corpus' size.
2. What is left is dealt to its buckets again with the bytes around it, sorted
   by multikey quicksort, and neighbours' common prefixes give the runs of equal
   windows at each offset; in a run all but the smallest document lose it.
3. Buckets of a divided token each name the smallest document they have for a
   window; these few rows are compared across the buckets' boundaries.

Whole copies of a text are settled before by the text's hash, as every byte of
them is repeated. Suffixes move as rows keyed by bucket, and per document as
lists no longer than its text.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows
of equal doc_id don't take from each other, and each stays (over a million
different texts of one doc_id raise an error); a null doc_id neither takes nor
loses; an empty table gives an empty result; very long texts are read whole, up
to the 2 GB of a value; other columns are kept by `remove`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_name, hashed_sample, materialize, small

LENGTH, KMER = 50, 24
SPAN = LENGTH - KMER + 1  # suffixes in a window; offsets are below it
LEAD = 16
#: Splitters come from about so many texts, TOKENS suffixes of each.
SAMPLE_TEXTS, TOKENS = 2000, 200
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: The bits of a hash that rank suffixes; below them is room for a place.
_UPPER = ~np.uint64((1 << 31) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes at each place that has them: 8-byte words,
    three to a hash, weighted and scrambled together. Equal hashes only let
    suffixes be looked at; what is removed is told by the bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(data) - KMER + 1
    h = words[:n] * _PRIME
    for at, by in zip(range(8, KMER, 8), _WEIGHTS, strict=True):
        h += words[at : at + n] * by
    return _mixed(h)


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each minimizing suffix:
    the leftmost of the least hashes in the windows from first to last."""
    h = kmer_hashes(data)
    n = len(data) - LENGTH + 1
    # The least of each window by doubling. A key is the upper bits of the hash
    # over the place, so that of equal ones the leftmost is least.
    low, width = (h & _UPPER) | np.arange(len(h), dtype=np.uint64), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        low = np.minimum(low[step:], low[: len(low) - step])
        width += step
    at = np.flatnonzero(np.r_[True, low[1:n] != low[: n - 1]])
    place = (low[at] & ~_UPPER).astype(np.int64)
    last = np.r_[at[1:], n] - 1
    return place, h[place], at, last


def leads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The leading tokens of suffixes."""
    cut = np.lib.stride_tricks.sliding_window_view(data, LEAD)[places]
    return np.ascontiguousarray(cut).view(f"S{LEAD}").ravel()


class Buckets:
    """Splitters, and how many buckets in a row one token fills."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splitters = np.sort(sample)[(np.arange(1, count) * len(sample)) // count] if len(sample) else sample

    def of(self, tokens: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, whether the token is divided over several)."""
        low, high = np.searchsorted(self.splitters, tokens, "left"), np.searchsorted(self.splitters, tokens, "right")
        width = np.maximum(high - low, 1)
        return low + np.where(width > 1, (doc * 0x9E3779B1 >> 7) % width, 0), width > 1


def multikey_sort(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of rows of 64-bit words: three-way partitions by one word, the
    middle part going on to the next word; small parts are sorted by all the
    words that are left."""
    out = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2 or d == words.shape[1]:
            continue
        part = out[lo:hi]
        if hi - lo < small:
            out[lo:hi] = part[np.lexsort(words[part, d:].T[::-1])]
            continue
        key = words[part, d]
        pivot = np.sort(key[:: len(key) // 255])[128]
        less, more = key < pivot, key > pivot
        out[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, d), (a, b, d + 1), (b, hi, d)]
    return out


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 12 | (place - first) << 6 | (place - last)


#: Texts that share a doc_id are told apart by a number above the place.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1
_VARIANTS = 1 << 63 - 12 - _PLACE_BITS
#: Bytes of text whose suffixes one task sorts.
TASK_BYTES = 16 << 20


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)


def sample_buckets(texts: DataFrame, count: int) -> Buckets:
    rows = hashed_sample(texts, SAMPLE_TEXTS, 3, "doc_id")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                data = _bytes_of(t)
                place = minimizers(data)[0]
                out.append(leads(data, place[:: max(1, len(place) // TOKENS)][:TOKENS]).tobytes())
            yield pd.DataFrame({"t": out})

    got = [r["t"] for r in rows.select("text").mapInPandas(tokens, "t binary").collect()]
    return Buckets(np.frombuffer(b"".join(bytes(t) for t in got), f"S{LEAD}"), count)


def shared_suffixes(texts: DataFrame, buckets: Buckets, parts: int) -> DataFrame:
    """(doc_id, at): packed places of the suffixes that may be shared."""
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            size = 0
            for doc, variant, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                place, h, first, last = minimizers(data)
                bucket, divided = buckets.of(leads(data, place), doc)
                # A divided token is common for certain: -1 - bucket passes it.
                for c, v in zip(cols, (np.where(divided, -1 - bucket, bucket), h.view(np.int64), np.full(len(h), doc), variant << _PLACE_BITS + 12 | _pack(place, first, last)), strict=True):
                    c.append(v)
                size += len(h)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["bucket", "h", "doc_id", "at"])
                    cols, size = [[], [], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["bucket", "h", "doc_id", "at"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if got:
            h, doc, at = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            keep = np.repeat(many, np.diff(np.r_[start, len(h)]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[order][keep])], ["doc_id", "at"])

    rows = texts.select("doc_id", "variant", "text").mapInArrow(suffixes, "bucket long, h long, doc_id long, at long")
    # Divided tokens are passed on untouched, the others are looked at by bucket.
    dealt = rows.repartition(parts, F.when(F.col("bucket") < 0, F.col("h").bitwiseXOR(F.col("doc_id"))).otherwise(F.col("bucket")))
    flagged = dealt.select(F.when(F.col("bucket") < 0, None).otherwise(F.col("h")).alias("h"), "doc_id", "at")

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for b in batches:
                sure = b.column(0).is_null()
                if sure.true_count:
                    passed.append(b.filter(sure).select(["doc_id", "at"]))
                yield b.filter(pc.invert(sure))

        passed: list[pa.RecordBatch] = []
        yield from shared(plain())
        yield from passed

    return flagged.mapInArrow(either, "doc_id long, at long")


def with_context(texts: DataFrame, shared: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, divided, doc_id, at, around) for each shared suffix; around is
    the SPAN - 1 bytes before it and the LENGTH from it on."""
    lists = shared.groupBy("doc_id", F.shiftright("at", _PLACE_BITS + 12).alias("variant")).agg(F.collect_list("at").alias("ats"))
    both = texts.join(lists, ["doc_id", "variant"]).select("doc_id", "text", "ats")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, ats in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                at = np.unique(ats.values.to_numpy())
                place = at >> 12 & _PLACE
                bucket, divided = buckets.of(leads(data, place), doc)
                padded = np.zeros(len(data) + SPAN - 1 + LENGTH, np.uint8)
                padded[SPAN - 1 : SPAN - 1 + len(data)] = data
                cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SPAN - 1 + LENGTH)[place])
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPAN - 1 + LENGTH), len(cut), [None, pa.py_buffer(cut)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(divided), pa.array(np.full(len(at), doc)), pa.array(at), blob], ["bucket", "divided", "doc_id", "at", "around"])

    return both.mapInArrow(around, "bucket long, divided boolean, doc_id long, at long, around binary")


def repeated_windows(contexts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, place, mask, window): bit a of mask says that the window from
    place - a on is repeated. Rows with a window name the smallest document of
    a divided bucket, yet to be compared with the other buckets'."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        divided, doc, at = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in (0, 1, 2))
        around = np.concatenate([np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in got])
        # Suffix first, then what stands before it, the nearest byte first.
        keyed = np.zeros((len(doc), -(-(LENGTH + SPAN - 1) // 8) * 8), np.uint8)
        keyed[:, :LENGTH] = around[:, SPAN - 1 :]
        keyed[:, LENGTH : LENGTH + SPAN - 1] = around[:, SPAN - 2 :: -1]
        order = multikey_sort(keyed.view(">u8").astype(np.uint64))
        divided, doc, at, around, keyed = divided[order], doc[order], at[order], around[order], keyed[order]
        place, most, least = at >> 12, at >> 6 & 63, at & 63
        # Rows of equal surroundings are one class: its windows are the same.
        differ = keyed[1:] != keyed[:-1]
        apart = differ.any(1)
        head = np.r_[True, apart]
        rank = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        common = np.r_[0, np.where(apart, differ.argmax(1), LENGTH)][heads]  # with the class before
        common = np.minimum(common, LENGTH)
        class_doc = np.minimum.reduceat(doc, heads)
        mask, left = np.zeros(len(doc), np.int64), np.zeros(len(heads), np.uint64)
        before = around[heads, : SPAN - 1]
        pend: list[tuple[np.ndarray, int]] = []
        for a in range(SPAN):
            if a:
                left = (left + before[:, SPAN - 1 - a].astype(np.uint64) + np.uint64(1)) * _PRIME
                left ^= left >> np.uint64(29)
            run = np.cumsum(common < LENGTH - a).astype(np.uint64)
            key = _mixed(left ^ run * np.uint64(0xD6E8FEB86659FD93))
            by = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
            first = np.empty(len(heads), np.int64)
            first[by] = np.repeat(np.minimum.reduceat(class_doc[by], start), np.diff(np.r_[start, len(by)]))
            first, mine = first[rank], (least <= a) & (a <= most)
            mask |= (mine & (doc > first)).astype(np.int64) << a
            # The smallest document's rows stand for the bucket.
            open_rows = np.flatnonzero(mine & divided & (doc == first))
            if len(open_rows):
                pend.append((open_rows, a))
        hit = mask != 0
        cols = [[doc[hit]], [place[hit]], [mask[hit]], [np.full(int(hit.sum()), "", object)]]
        for rows, a in pend:
            windows = around[rows, SPAN - 1 - a : SPAN - 1 - a + LENGTH]
            for c, v in zip(cols, (doc[rows], place[rows], np.full(len(rows), 1 << a), np.array([hashlib.md5(w.tobytes()).hexdigest() for w in windows], object)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["doc_id", "place", "mask", "window"])

    dealt = contexts.repartition(parts, "bucket").select("divided", "doc_id", "at", "around")
    return dealt.mapInArrow(local, "doc_id long, place long, mask long, window string")


def spans_by_document(texts: DataFrame, total: int) -> DataFrame:
    """(doc_id, variant, places, masks) of the repeated windows of texts
    (doc_id, variant, text), none of them null, of ``total`` bytes at most."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    buckets = sample_buckets(texts, 8 * parts)
    shared = materialize(shared_suffixes(texts, buckets, parts), "shared-suffixes")
    found = materialize(repeated_windows(with_context(texts, shared, buckets), parts), "repeated-windows")
    # A window that stands in many buckets is counted by each task before, and its rows can be split in the join.
    across = found.filter("window <> ''")
    least = across.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("window", "least")
    more = across.join(small(materialize(least, "least-across")), "window").filter("doc_id > least").select("doc_id", "place", "mask")
    every = found.filter("window = ''").select("doc_id", "place", "mask").unionByName(more)
    spans = materialize(every.groupBy("doc_id", F.shiftright("place", _PLACE_BITS).alias("variant")).agg(F.collect_list(F.col("place").bitwiseAND(_PLACE)).alias("places"), F.collect_list("mask").alias("masks")), "repeated-places")
    discard(shared, found)
    return spans


def covered(n: int, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a repeated window."""
    change = np.zeros(n + 1, np.int64)
    for a in range(SPAN):
        start = places[masks >> a & 1 == 1] - a
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    return np.cumsum(change[:n]) > 0


def _placed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column ``name``, a struct of copy (a smaller document has the same
    text), places and masks."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.md5(text.cast("binary")).alias("_m")).filter("doc_id is not null")
    firsts = keyed.groupBy("_m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    # Written first: then a text that stands very often can be split in the join.
    firsts = small(materialize(firsts, "first-copies"))
    copies = small(materialize(keyed.join(firsts, "_m").filter("doc_id <> first").select("doc_id", "_m").distinct(), "whole-copies"))
    # Few doc_ids have several texts; those texts are numbered.
    several = keyed.groupBy("doc_id").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi")).filter("lo <> hi").select("doc_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_m")).cast("long")
    checked = F.when(number < _VARIANTS, number).otherwise(F.raise_error(F.lit(f"a doc_id has {_VARIANTS} different texts or more")).cast("long"))
    numbered = keyed.join(several, "doc_id").distinct().withColumn("variant", checked)
    variants = small(materialize(numbered, "text-variants"))
    texts = docs.filter("doc_id is not null").select("doc_id", text.alias("text")).filter(F.octet_length("text") >= LENGTH)
    alone = texts.withColumn("_m", F.md5(F.col("text").cast("binary"))).join(copies, ["doc_id", "_m"], "left_anti").join(variants, ["doc_id", "_m"], "left")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spans = spans_by_document(alone.select("doc_id", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"), "text"), total)
    digest = fresh_name("digest", docs)
    marked = docs.withColumn(digest, F.md5(text.cast("binary")))
    ids = [fresh_name(f"id{i}", docs) for i in range(3)]
    whole = copies.select(F.col("doc_id").alias(ids[0]), F.col("_m").alias(ids[1]), F.lit(True).alias(ids[2]))
    one = marked.join(whole, (marked["doc_id"] == whole[ids[0]]) & (marked[digest] == whole[ids[1]]), "left").select(*marked.columns, ids[2])
    which = variants.select(F.col("doc_id").alias(ids[0]), F.col("_m").alias(ids[1]), F.col("variant").alias(name))
    two = one.join(which, (one["doc_id"] == which[ids[0]]) & (one[digest] == which[ids[1]]), "left").select(*one.columns, F.coalesce(name, F.lit(0).cast("long")).alias(name))
    at = spans.select(F.col("doc_id").alias(ids[0]), F.col("variant").alias(ids[1]), F.struct("places", "masks").alias(digest))
    three = two.drop(digest).join(at, (two["doc_id"] == at[ids[0]]) & (two[name] == at[ids[1]]), "left")
    return three.select(*docs.columns, F.struct(F.col(ids[2]).alias("copy"), F.col(digest)["places"].alias("places"), F.col(digest)["masks"].alias("masks")).alias(name))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def measure(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, copies, places, masks in batches:
            rows = []
            for t, copy, p, m in zip(texts, copies, places, masks, strict=True):
                data = t.encode() if t else b""
                if copy is True and len(data) >= LENGTH:
                    rows.append((len(data), len(data), 1, hashlib.sha256(b"").hexdigest()))
                elif p is None:
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                else:
                    gone = covered(len(data), np.asarray(p), np.asarray(m))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    rows.append((len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    placed = _placed(docs.select("doc_id", "text"), "found")
    # Written here, where batches are small.
    return materialize(placed.withColumn("r", measure("text", "found.copy", "found.places", "found.masks")).select("doc_id", "r.*"), "repeats")


def remove(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text; a code point goes with its
    first removed byte."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, copies, places, masks in batches:
            out = []
            for t, copy, p, m in zip(texts, copies, places, masks, strict=True):
                data = t.encode() if t else b""
                if copy is True and len(data) >= LENGTH:
                    out.append("")
                elif p is None:
                    out.append(t)
                else:
                    gone = covered(len(data), np.asarray(p), np.asarray(m))
                    out.append(np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore"))
            yield pd.Series(out, dtype=object)

    name = fresh_name("found", docs)
    return _placed(docs, name).withColumn("text", cut("text", *(F.col(name)[part] for part in ("copy", "places", "masks")))).select(*docs.columns)
