"""Mixing sources to target weights: capped water-filling.

Every source has a weight and shares the budget by it. A source stops at
``max_epochs`` times its own size; what it can't take is shared again among
the others in proportion to their weights, until no source is above its cap
(`water_fill`). A source's target then becomes repetitions: each of its
documents is taken floor(target / size) times, and a seeded part of them once
more (`mix`).

The part is chosen by a seeded hash of each document. Per source one cut on
that hash is found from 4,096 bucket sums and a look into the one bucket that
holds the cut, a row for each of its hashes, so neither a source with a third of
all rows nor one row repeated as often passes through one task. Rows of equal
doc_id and text share a hash; where the cut falls among them they are numbered,
split by split, and as many are taken as come nearest to the target.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; sources of size 0 get target 0; of rows with equal doc_id and
text any may be the ones taken once more; an empty table gives an empty result;
very long texts are counted whole; other columns of the input are kept, those
that clash with the added ones are replaced (`with_repeats` keeps all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, fresh_name, materialize, range_ranked, small

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17
_BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, so that null is joined as a source like any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Sources in code point order, null last, take ``weights`` in turn; the
    targets sum to ``budget`` of all sizes if the caps allow it. A level L is
    raised until sum(min(cap, weight * L)) is the budget: each round fixes the
    sources below it at their caps and needs two sums, never the rows.
    """
    ranked = range_ranked(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    turn = F.array(*map(F.lit, weights))
    weighted = materialize(ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"), "mix-weights")
    cap, want = F.col("source_size") * max_epochs, F.col("weight")
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, rounds = 0.0, 0
    while True:
        full = cap < want * level
        fixed, open_weight = weighted.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, want))).first()
        raised = (total - (fixed or 0) * max_epochs) / open_weight if open_weight else level
        rounds += 1
        if raised <= level or not open_weight:
            break
        level = raised
    return weighted.withColumn("target", F.least(cap.cast("double"), want * F.lit(float(level))))


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with ``name`` (0, 1, ... for each value of keys), by the splits of a
    written copy, so that no value is gathered in one task."""
    part, shift = fresh_name("part", rows), fresh_name("shift", rows)
    held = materialize(rows.withColumn(part, F.spark_partition_id()), "mix-edges")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*keys, part).agg(F.count("*").alias(name))
    shifts = materialize(counts.select(*keys, part, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(shift)), "mix-shifts")
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(part)) - 1
    return held.withColumn(name, local).join(small(shifts), [*keys, part]).withColumn(name, F.col(name) + F.col(shift)).drop(part, shift)


def with_repeats(docs: DataFrame, name: str, weights: Sequence[float] = WEIGHTS, budget: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with a column ``name``, a struct of size, source_size, target and
    repeats: how often the mix takes the document."""
    key, h, plan_name = (fresh_name(n, docs) for n in ("key", "hash", "plan"))
    sized = docs.withColumns({name: word_count(F.col("text")), key: _source_key(F.col("source")), h: F.xxhash64(F.lit(seed), "doc_id", "text")})
    bucket_of = lambda h: F.shiftrightunsigned(h, 64 - _BUCKET_BITS).cast("int")
    # Signed hashes run from the middle bucket on; any fixed order will do.
    narrow = materialize(sized.select("source", F.col(key).alias("key"), F.col(name).alias("size"), F.col(h).alias("h"), bucket_of(F.col(h)).alias("bucket")), "mix-sizes")
    buckets = materialize(narrow.groupBy("source", "key", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = buckets.groupBy("source", "key").agg(F.sum("bucket_size").alias("source_size"))
    filled = water_fill(sources, weights, budget, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = small(materialize(filled.select("key", "source_size", "target", F.floor(rate + 1e-12).cast("long").alias("whole"), (F.col("target") - F.floor(rate + 1e-12) * F.col("source_size")).alias("need")), "mix-plan"))

    run = Window.partitionBy("key").orderBy("bucket")
    at = buckets.join(plan.select("key", "need"), "key").withColumn("before", F.sum("bucket_size").over(run) - F.col("bucket_size"))
    # The last bucket that starts below what is needed holds the cut, and in it the last hash that does.
    edge = materialize(at.filter((F.col("before") < F.col("need")) & (F.col("need") > 0)).groupBy("key").agg(F.max("bucket").alias("bucket"), F.max("before").alias("before"), F.max("need").alias("need")), "mix-edge-buckets")
    each = narrow.join(small(edge), ["key", "bucket"]).groupBy("key", "bucket", "h").agg(F.sum("size").alias("own"), F.count("*").alias("n"), F.max("before").alias("before"), F.max("need").alias("need"))
    start = F.col("before") + F.sum("own").over(Window.partitionBy("key", "bucket").orderBy("h")) - F.col("own")
    last = each.withColumn("start", start).filter("start < need").groupBy("key").agg(F.max(F.struct("start", "h", "bucket", "own", "n", "need")).alias("c"))
    few = F.least(F.round((F.col("c.need") - F.col("c.start")) / (F.greatest("c.own", F.lit(1)) / F.col("c.n"))), F.col("c.n")).cast("long")
    cuts = last.select("key", F.struct(F.col("c.bucket").alias("bucket"), F.col("c.h").alias("h"), few.alias("few")).alias("cut"))
    plan = small(materialize(plan.join(cuts, "key", "left").select(F.col("key").alias(key), F.struct("source_size", "target", "whole", "cut").alias(plan_name)), "mix-cuts"))
    discard(narrow, buckets, edge)

    cut = F.col(plan_name)["cut"]
    planned = sized.join(plan, key)
    at_cut = F.coalesce(F.col(h) == cut["h"], F.lit(False))
    below = F.coalesce((bucket_of(F.col(h)) < cut["bucket"]) | ((bucket_of(F.col(h)) == cut["bucket"]) & (F.col(h) < cut["h"])), F.lit(False))
    place = fresh_name("place", planned)
    edges = _numbered(planned.filter(at_cut), [key], place)

    def counted(rows: DataFrame, more: Column) -> DataFrame:
        got = F.struct(F.col(name).alias("size"), F.col(plan_name)["source_size"].alias("source_size"), F.col(plan_name)["target"].alias("target"), (F.col(plan_name)["whole"] + more.cast("long")).alias("repeats"))
        return rows.select(*docs.columns, got.alias(name))

    return counted(planned.filter(~at_cut), below).unionByName(counted(edges, F.col(place) < cut["few"]))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, repeats and taken, the words that
    makes (repeats * size)."""
    docs = docs.drop("size", "source_size", "target", "repeats", "taken")
    name = fresh_name("mix", docs)
    got = with_repeats(docs, name, weights, budget, max_epochs, seed)
    return got.select(*docs.columns, f"{name}.*").withColumn("taken", F.col("repeats") * F.col("size"))
