"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's
distinct five-word shingles (words are runs without ASCII white space, case
kept; fewer than five words are one shingle, no words none). The sketch of a
whole is the k smallest of its parts' sketches (`merge`), and two sketches
give `resemblance`, `containment` and `distinct_count`. Sketches of fewer than
k hashes hold every shingle, so their answers are exact.

All of it is array functions on the row at hand; only `with_next_fingerprint`
shuffles, and it moves each text once.

Defined cases: null text counts as empty, its fingerprint is the empty string;
two empty sketches resemble each other by 1, an empty and another by 0; rows
of equal doc_id follow each other by text (null first), and a table of one row
is its own neighbour; an empty table gives an empty result; very long texts are
read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, split_words

K = 64
SHINGLE = 5


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, or of the whole if it is shorter."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the union's sketch in both."""
    top = merge(a, b, k)
    return F.when(F.size(top) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(top, a), b)) / F.size(top))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over
    the k-th smallest hash as a share of the hash range."""
    share = (F.element_at(a, F.lit(k)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(common / distinct_count(a, k), F.lit(1.0)))


def as_text(sketch: Column) -> Column:
    """16 hex digits a hash, smallest first; equal sketches, equal strings."""
    return F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """docs with ``sketch``."""
    words = docs.withColumn("_words", split_words(F.col("text")))
    return words.withColumn("sketch", bottom_k(shingle_hashes(F.col("_words"), size), k)).drop("_words")


def _splitters(docs: DataFrame, per_bucket: int, most: int) -> tuple[list[int], int]:
    """Sampled doc_ids that cut the table into even ranges, ascending, at most
    ``most``, and into how many buckets each range is divided evenly by its
    doc_ids, so that buckets don't grow with the table."""
    count, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cuts = min(most, count // per_bucket)
    if cuts < 1:
        return [], 1
    shares = ",".join(str((i + 1) / (cuts + 1)) for i in range(cuts))
    found = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {10 * max(cuts, 100)})")).first()[0] or []
    ends = {low, high} if low is not None else set()
    return sorted({*found, *ends}), -(-count // ((cuts + 1) * per_bucket))


def range_bucket(doc_id: Column, splitters: list[int]) -> Column:
    """0, 1, ... from the highest range down; null is last. A look into chunks
    of splitters and one into the chunk keep it at two square roots a row."""
    if not splitters:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    step = max(1, int(len(splitters) ** 0.5))
    chunks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= doc_id))
    whole = below(longs([c[0] for c in chunks]))
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";"), lambda c: F.split(c, ",").cast("array<bigint>"))
    inside = below(F.element_at(nested, F.greatest(whole, F.lit(1))))
    at_or_below = F.when(whole == 0, 0).otherwise((whole - 1) * step + inside)
    return F.when(doc_id.isNull(), len(splitters) + 1).otherwise(F.lit(len(splitters)) - at_or_below)


def divided_bucket(doc_id: Column, splitters: list[int], parts: int) -> Column:
    """`range_bucket`, each range divided into ``parts`` of equal width."""
    bucket = range_bucket(doc_id, splitters).cast("long")
    if parts == 1 or not splitters:
        return bucket * parts
    # Range r from the highest down lies between these; the ends are open and hold one doc_id at most.
    ends = F.split(F.lit(",".join(map(str, [*splitters[::-1], splitters[0]]))), ",").cast("array<bigint>")
    at = F.least(F.greatest(bucket, F.lit(1)), F.lit(len(splitters))).cast("int")
    low, high = F.element_at(ends, at + 1 if len(splitters) > 1 else at), F.element_at(ends, at)
    inside = F.floor((high - doc_id).cast("double") / F.greatest(high - low, F.lit(1)) * parts)
    return bucket * parts + F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)), F.lit(0))


def with_next_fingerprint(docs: DataFrame, k: int = K, size: int = SHINGLE, per_bucket: int = 2000, most_ranges: int = 16384) -> DataFrame:
    """Each document against an edit of itself and against the next one.

    The next document is the one after it by descending doc_id, the first
    after the last. The edit replaces the last floor(n_chars / 2) code points
    by the first as many (or all) of the next document. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_shingles (estimated) and held (the part of the edit's shingles
    that the document has).

    Sampled splitters deal the rows to ranges of doc_id, and these to buckets,
    so texts are shuffled once; each bucket also gets the head of the one after
    it as a guest.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    splitters, parts = _splitters(base.select("doc_id"), per_bucket, most_ranges)
    base = base.withColumn("bucket", divided_bucket(F.col("doc_id"), splitters, parts))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]

    tops = materialize(base.groupBy("bucket").agg(F.max("doc_id").alias("top")), "fingerprint-buckets")
    known = small(tops.withColumnRenamed("bucket", "at"))
    heads = base.join(known, (base.bucket == known["at"]) & base.doc_id.eqNullSafe(known.top)).select(base["*"])
    first = heads.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter("_n = 1").drop("_n")
    # The bucket before each one: in its range, or the last of the range before. The one window over all has a
    # row for each range, of which there are most_ranges + 2 at the most.
    ranged = tops.select("bucket", F.expr(f"bucket div {parts}").alias("range"))
    lasts = ranged.groupBy("range").agg(F.max("bucket").alias("last"))
    around = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lasts.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(around)).alias("before"))
    inside = ranged.withColumn("inside", F.lag("bucket").over(Window.partitionBy("range").orderBy("bucket")))
    hosts = inside.join(F.broadcast(before), "range").select("bucket", F.coalesce("inside", "before").alias("host"))
    hosts = small(materialize(hosts, "fingerprint-hosts"))
    guests = first.join(hosts, "bucket").select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))

    rows = fingerprints(base.withColumn("guest", F.lit(False)).unionByName(guests), k, size)
    line = Window.partitionBy("bucket").orderBy("guest", *order)
    paired = rows.withColumns({"next_text": F.lead("text").over(line), "next_sketch": F.lead("sketch").over(line)}).filter("not guest")
    n = F.length("text")
    sized = paired.withColumns({"n_chars": n.cast("long"), "takes": (n / 2).cast("int")})
    edited = sized.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - takes), substring(next_text, 1, takes))"))
    # The words are a column of their own, or each shingle would split anew.
    words = edited.withColumn("edited_words", split_words(F.col("edited")))
    out = words.withColumn("edited_sketch", bottom_k(shingle_hashes(F.col("edited_words"), size), k))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("held"),
    )
