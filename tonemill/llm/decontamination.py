"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores postings (term, document, position) of the training
tokens that are benchmark terms, in one shard per input split, each ordered by
term; no posting is shuffled for it. `find_phrases` looks for
every window of benchmark words in it: the window's rarest term gives aligned
candidates, the next rarest prunes them, and the lists of the remaining terms
are intersected at their offsets; runs of a window's length or more are the
exact occurrences. `find_near` returns proximity matches: documents where as
many terms of an item as a window has stand within a span of positions.

Nothing is grouped by a frequent term alone: shards are cut by documents,
candidates come from rare terms, and hits are merged per document.

Defined cases: null and word-free texts have no words and match nothing; an
item of fewer words than a window is one window, an item without words none;
rows of documents are told apart by doc_id and text, so repeated rows get the
same result and each stays; items of equal item_id count once; a null item_id
counts as the empty string; an empty table gives an empty result, and without a
benchmark nothing is hit; very long texts are read whole; other columns are
ignored here, and kept by the pipeline's filter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh_name, materialize, small

WINDOW = 10
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z are lower-cased; enough to count words.
_NOT_WORD_YET = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of `words`. Only the first and last part of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), _NOT_WORD_YET)
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - ends).cast("long")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of documents apart by doc_id and text."""
    return F.xxhash64(doc_id, text)


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, ipos, term) for each word of each item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    items = items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("n"), "w")
    return items.select("item", "item_id", "n", F.posexplode("w").alias("ipos", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term_id, doc, pos) of the tokens of docs that are in ``terms``
    (term_id), in the shared folder. Positions count from 0 or 1, alike within
    a document. Terms are known by a 64-bit hash."""
    parts = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _NOT_WORD)
    tokens = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("doc"), F.posexplode(parts).alias("pos", "term"))
    hashed = tokens.select(F.xxhash64("term").alias("term_id"), "doc", "pos")
    postings = hashed.join(small(terms), "term_id").select("term_id", "doc", "pos")
    return materialize(postings.sortWithinPartitions("term_id", "doc", "pos"), "postings")


def _ranked_terms(places: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """The two rarest places of every window that can occur at all."""
    frequency = index.groupBy("term_id").agg(F.count("*").alias("df"))
    known = places.join(small(materialize(frequency, "term-frequencies")), "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    length = F.least("n", F.lit(window))
    inside = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    spans = known.withColumn("span", F.sort_array(F.collect_list(F.struct("df", "ipos", "term_id")).over(inside))).filter(F.size("span") >= length)
    rare = spans.filter(F.col("span")[0]["df"] > 0)
    second = F.when(F.size("span") > 1, F.col("span")[F.when(F.size("span") > 1, 1).otherwise(0)]).otherwise(F.col("span")[0])
    return rare.select("item", F.col("span")[0].alias("a"), second.alias("b")).distinct()


def find_phrases(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact occurrences: (doc, item, start, length) of maximal runs of at
    least a window's words; ``places`` is (item, n, ipos, term_id)."""
    pairs = materialize(_ranked_terms(places, index, window), "window-anchors")
    anchors = pairs.select("item", F.col("a.term_id").alias("term_id"), F.col("a.ipos").alias("ipos"), F.col("b.term_id").alias("term_b"), F.col("b.ipos").alias("ipos_b"))
    aligned = index.join(small(anchors), "term_id").select("item", "doc", (F.col("pos") - F.col("ipos")).alias("delta"), F.col("term_b").alias("term_id"), (F.col("pos") - F.col("ipos") + F.col("ipos_b")).alias("pos"))
    second = index.join(small(anchors.select(F.col("term_b").alias("term_id")).distinct()), "term_id", "left_semi")
    candidates = materialize(aligned.join(second, ["term_id", "doc", "pos"], "left_semi").select("item", "doc", "delta").distinct(), "alignments")
    expected = candidates.join(small(places), "item").select("item", "doc", "delta", "n", "ipos", "term_id", (F.col("delta") + F.col("ipos")).alias("pos")).filter("pos >= 0")
    held = index.join(small(candidates.select("doc").distinct()), "doc", "left_semi")
    matched = expected.join(held, ["term_id", "doc", "pos"], "left_semi")
    line = Window.partitionBy("item", "doc", "delta").orderBy("ipos")
    runs = matched.withColumn("run", F.col("ipos") - F.row_number().over(line)).groupBy("item", "doc", "delta", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.max("n").alias("n"))
    return runs.filter(F.col("length") >= F.least("n", F.lit(window))).select("doc", "item", "start", "length")


def find_near(index: DataFrame, places: DataFrame, span: int, window: int = WINDOW) -> DataFrame:
    """Proximity matches: (doc, item, first, last) where at least ``window``
    distinct terms of an item (or all, if it has fewer) lie within ``span``
    positions. Of an item's T terms, ``need`` of which must be there, one of the
    T - need + 1 rarest must be, too: their lists are looked up first, and only
    the documents on them are searched for the rest."""
    terms = materialize(places.select("item", "term_id").distinct(), "near-terms")
    frequency = materialize(index.join(small(terms.select("term_id").distinct()), "term_id").groupBy("term_id").agg(F.count("*").alias("df")), "near-frequencies")
    need = terms.groupBy("item").agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(window)).alias("need"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("df", "term_id"))
    known = terms.join(small(frequency), "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rank)
    rare = materialize(known.join(need, "item").filter(F.col("rank") <= F.col("n") - F.col("need") + 1).select("item", "term_id"), "near-anchors")
    candidates = materialize(index.join(small(rare), "term_id").select("item", "doc").distinct(), "near-candidates")
    postings = index.join(small(terms), "term_id").join(small(candidates), ["item", "doc"])
    near = Window.partitionBy("item", "doc").orderBy("pos").rangeBetween(0, span - 1)
    seen = postings.withColumns({"found": F.size(F.collect_set("term_id").over(near)), "last": F.max("pos").over(near)})
    return seen.join(need, "item").filter(F.col("found") >= F.col("need")).groupBy("doc", "item").agg(F.min("pos").alias("first"), F.max("last").alias("last"))


def covered(occurrences: DataFrame) -> DataFrame:
    """(doc, n_hit): positions inside the union of a document's occurrences."""
    run = Window.partitionBy("doc").orderBy("start", "end")
    spans = occurrences.select("doc", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("from", F.greatest("start", F.coalesce(reach, F.col("start"))))
    return fresh.groupBy("doc").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, n_hit, n_items, items_sha256) for each document with a hit."""
    places = materialize(item_words(benchmark), "item-words")
    terms = materialize(places.select(F.xxhash64("term").alias("term_id")).distinct(), "terms")
    index = build_index(docs, terms)
    found = materialize(find_phrases(index, places.withColumn("term_id", F.xxhash64("term")).select("item", "n", "ipos", "term_id"), window), "occurrences")
    names = found.select("doc", "item").distinct().join(small(places.select("item", "item_id").distinct()), "item")
    items = names.groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hits = items.join(covered(found), "doc").select("doc", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    hits = materialize(hits, "contamination")
    discard(index, found)
    return hits


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row."""
    hits = contamination(docs, benchmark, window)
    rows = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("doc"), word_count(F.col("text")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(small(hits), "doc", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all columns."""
    name = fresh_name("doc", docs)
    hits = contamination(docs, benchmark, window).select(F.col("doc").alias(name))
    keyed = docs.withColumn(name, doc_key(F.col("doc_id"), F.col("text")))
    return keyed.join(small(hits), name, "left_anti").select(*docs.columns)
