"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct shingles of words. Its sketch deals the
64-bit shingle hashes to 256 buckets and keeps, for the least hash of each, the
number of leading zeros and ten mantissa bits (two bytes a bucket; an empty
bucket borrows the register of the first filled one in a probing order of its
own). Registers are banded; documents that share a band are candidates, a
collision-corrected estimate drops hopeless pairs, and the rest are confirmed
on the full sets.

No group is expanded into its pairs. Documents of equal sets are one class,
confirmed against its smallest document. In a band's group every class is
paired with one member only, the hub: that which has most company over all its
bands (in a family of edits, their common source). Each class tries the one hub
with which it shares most bands, which joins nearly all copies to a component.

What is left are groups that still hold more than one component, often families
of texts that are alike, but not enough. There each document is known by how it
differs from the hub: two sets differ from each other by what is in one of
their differences to the hub and not in the other. A document whose difference
is small enough links to the hub. Any other two that are similar enough must
share a part of their differences that is known beforehand, so a prefix filter
over the differences, the rarest in the group first, with the bound on
positions as a condition of the join, lets few pairs meet that don't link: what
a family has in common is in no difference, and what an edit adds is rare.
Distances between sets are a metric, so most are spared even that: components
whose heads are too far apart can't link (`partners`), and two documents whose
differences' parities are too unlike aren't a pair. Links that joined components
can't come from are so decided on full sets; the registers give the groups, the
hubs and the estimate before that. Pairs that do meet are estimated and confirmed.

With six registers a band and 42 bands a pair at similarity 0.8 is missed with
probability (1 - 0.8^6)^42 = 3e-6, and the estimate's margin is six standard
errors.

Defined cases: null and wordless texts have an empty set and link to nothing;
fewer words than a shingle are one shingle; a set too small to reach the
threshold with any other set links to equal sets only; rows of equal doc_id
are one document, repeated rows each stay; a null doc_id links to nothing, its
component_id is null and it is kept; an empty table gives an empty result; very
long texts are read whole; other columns are kept by `dedupe`, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small, trim

BUCKETS, MANTISSA, BAND_ROWS = 256, 10, 6
BANDS = BUCKETS // BAND_ROWS
PERCENT = 80
MARGIN = 0.15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CACHE = 100_000
#: Components of a group that are told apart by distance, and words of parities.
FEW, SIGNS = 64, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _shingles(words: list[int], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, or of the whole if it is shorter."""
    w = np.array(words, dtype=np.uint64)
    n = min(size, len(w))
    total = np.full(len(w) - n + 1, 0x9E3779B97F4A7C15 * (size - n) & (1 << 64) - 1, np.uint64)
    for j in range(n):
        total = _mixed(total + w[j : len(w) - n + 1 + j] * np.uint64(2 * j + 3))
    return total


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased words between
    ASCII white space."""
    words = text.encode().lower().split() if text else []
    return np.unique(_shingles([hashes[x] for x in words], size)) if words else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The `shingle_set` of each text, laid end to end, and their lengths."""
    known = hashes.__getitem__
    split = [list(map(known, t.lower().split())) if t else [] for t in texts]
    counts = np.array([max(len(w) - size + 1, min(len(w), 1)) for w in split])
    ends = counts.cumsum()
    flat = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    # One run over all words; runs across two texts are left out, short texts stand alone.
    every = _shingles([x for w in split if len(w) >= size for x in w], size) if any(len(w) >= size for w in split) else flat
    at = 0
    for w, end, n in zip(split, ends, counts, strict=True):
        if len(w) >= size:
            flat[end - n : end] = every[at : at + n]
            at += len(w)
        elif w:
            flat[end - 1] = _shingles(w, size)[0]
        flat[end - n : end].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[(ends - counts)[counts > 0]] = True
    kept = np.concatenate([[0], fresh.cumsum()])
    return flat[fresh], kept[ends] - kept[ends - counts]


def _probes() -> np.ndarray:
    rng = np.random.default_rng(1)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(hashes: np.ndarray, lengths: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The sketches of non-empty sorted sets, laid end to end: leading zeros and
    mantissa of the least hash of each bucket, borrowed where one is empty."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    cell = doc * BUCKETS + (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    rest = (hashes[first] << np.uint64(8)) >> np.uint64(8)  # 56 bits
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # position of the highest one
    bits -= (rest < (np.uint64(1) << np.maximum(bits - 1, 0).astype(np.uint64))) & (rest > 0)
    zeros = 56 - bits
    shift = (bits - 1 - MANTISSA).clip(0)
    mantissa = (rest >> shift.astype(np.uint64)).astype(np.int64) & ((1 << MANTISSA) - 1)
    out = np.zeros((len(lengths), BUCKETS), np.uint16)
    filled = np.zeros((len(lengths), BUCKETS), bool)
    out.reshape(-1)[cell[first]] = zeros << MANTISSA | mantissa
    filled.reshape(-1)[cell[first]] = True
    row, column = np.nonzero(~filled)
    for probe in probes.T:  # each empty bucket asks one bucket after the other
        if not len(row):
            break
        asked = probe[column]
        got = filled[row, asked]
        out[row[got], column[got]] = out[row[got], asked[got]]
        row, column = row[~got], column[~got]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers of each sketch."""
    rows = sketches[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(BAND_ROWS):
        key = _mixed(key * np.uint64(0x100000001B3) + rows[:, :, j])
    return key.view(np.int64)


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what equal
    registers of unequal hashes give: the sum of 4^-z over leading zeros z,
    times one in 2^MANTISSA."""
    chance = 1 / 3 / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch, bands) of each row of docs: the set's size,
    two sums over it that tell sets apart, the registers and the bands' keys;
    the last two are null for sets that can only link to equal ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, probes = WordHashes(), _probes()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            flat, n = shingle_sets(texts, size, hashes)
            some = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                starts = (n.cumsum() - n)[some]
                k1[some] = np.add.reduceat(flat, starts)
                k2[some] = np.add.reduceat(_mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
            large = (100 * n >= PERCENT * (n + 1)) & (n > 0)
            r = registers(flat[np.repeat(large, n)], n[large], probes) if large.any() else np.zeros((0, BUCKETS), np.uint16)
            places = np.where(large, large.cumsum() - 1, -1)
            taken = pa.array(places, mask=~large)
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), len(r), [None, pa.py_buffer(np.ascontiguousarray(r))]).cast(pa.binary())
            keys = pa.ListArray.from_arrays(np.arange(len(r) + 1, dtype=np.int32) * BANDS, pa.array(band_keys(r).ravel()))
            cols = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), held.take(taken), keys.take(taken)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "k1", "k2", "sketch", "bands"])
        del hashes
        trim()

    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(sketch, f"doc_id {kind}, n long, k1 long, k2 long, sketch binary, bands array<long>")


def _estimated(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def estimated(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(c), np.uint16).reshape(-1, BUCKETS) for c in (a, b))
        return pd.Series(estimate((x == y).mean(1)))

    # Else the filter on it and the column would each run it.
    return estimated.asNondeterministic()(a, b)


def _linked(size: int):
    """Whether two texts' full sets are similar enough; a null second text
    stands for the first one."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes, last = WordHashes(), (None, None)
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                if y is None:
                    out.append(True)
                    continue
                if last[0] != x:
                    last = (x, shingle_set(x, size, hashes))
                s, t = last[1], shingle_set(y, size, hashes)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield pd.Series(out, dtype=bool)
        del hashes
        trim()

    return linked


def confirm(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough."""
    ends = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ends")
    texts = docs.select("doc_id", "text").join(small(ends), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    # Equal texts needn't be told apart word by word.
    differ = F.when(F.col("text_a") != F.col("text_b"), F.col("text_b"))
    read = both.select("a", "b", F.when(differ.isNotNull(), F.col("text_a")).alias("text_a"), differ.alias("text_b"))
    found = materialize(read.filter(_linked(size)("text_a", "text_b")).select("a", "b").distinct(), "confirmed")
    discard(ends)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the edges (a, b) reach, for each
    id on an edge. Each round takes the least label among neighbours and the
    label of the label; it ends when no label changes."""
    ways = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = materialize(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "components")
    while True:
        near = ways.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        fresh = labels.join(jump, "component").join(near, "id").select("id", F.least("far", "near").alias("component"), F.col("component").alias("was"))
        labels = materialize(fresh, "components")
        if not labels.filter("component <> was").limit(1).count():
            return labels.select("id", "component")


def held_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, v, t) for each text of the documents in ``ids``: its shingles
    t, and v, which tells texts of one doc_id apart; repeated rows once."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shingle_set(t, size, hashes).view(np.int64) for t in texts], dtype=object)
        del hashes
        trim()

    texts = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").filter("text is not null")
    apart = texts.withColumn("v", F.xxhash64("text")).dropDuplicates(["doc_id", "v"])
    return apart.select("doc_id", "v", shingles("text").alias("t")).filter(F.size("t") > 0)


def _parities() -> Column:
    """SIGNS words of 64 bits, each bit whether an odd number of the shingles in
    ``d`` fall on it: two sets differ in no fewer shingles than their words in bits."""
    word = "aggregate(d, 0L, (held, shingle) -> if((shingle & {m}) = {i}, held ^ shiftleft(1L, cast(shiftright(shingle, {b}) & 63 as int)), held))"
    return F.array(*[F.expr(word.format(m=SIGNS - 1, b=SIGNS.bit_length() - 1, i=i)) for i in range(SIGNS)])


def partners(differ: DataFrame, group: list[str]) -> DataFrame:
    """(group, doc_id, v, part, mask): with which other components of its group,
    of at most 64, a document may link, by distances between sets alone, which
    are a metric; part is its own component's number, mask has a bit for each of
    the others. Documents without any are left out.

    A component is known by one document, its head. Two documents link at a
    distance of down (n + n') / up at the most, so never where their heads are
    farther apart than that and their own distances to them together: gap >
    slack + slack', with gap = up times the heads' distance, and slack = up times
    a document's distance to its head, plus down n."""
    up, down = 100 + PERCENT, 100 - PERCENT
    apart = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    first = differ.groupBy(*group, "component").agg(F.min_by("d", F.struct("m", "doc_id", "v")).alias("head"))
    part = F.row_number().over(Window.partitionBy(*group).orderBy("component")) - 1
    heads = materialize(first.withColumn("part", part), "component-heads")
    slack = up * apart("d", "head") + down * F.col("n")
    near = materialize(differ.join(heads, [*group, "component"]).select(*group, "doc_id", "v", "component", "part", slack.alias("slack")), "head-distances")
    wide = heads.join(near.groupBy(*group, "component").agg(F.max("slack").alias("wide")), [*group, "component"])
    other = wide.select(*group, F.col("part").alias("other"), F.col("head").alias("other_head"), F.col("wide").alias("other_wide"))
    ways = wide.join(other, group).filter("part <> other").withColumn("gap", up * apart("head", "other_head")).filter("gap <= wide + other_wide")
    # At most 63 for each component.
    ways = materialize(ways.groupBy(*group, "component").agg(F.collect_list(F.struct("other", "gap", F.col("other_wide").alias("wide"))).alias("ways")), "component-ways")
    mask = F.expr("aggregate(ways, 0L, (held, w) -> if(w.gap <= slack + w.wide, held | shiftleft(1L, w.other), held))")
    out = materialize(near.join(ways, [*group, "component"]).select(*group, "doc_id", "v", "part", mask.alias("mask")).filter("mask <> 0"), "component-partners")
    discard(heads, near, ways)
    return out


def meetings(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that may link, from ``groups``
    (hub, doc_id, component), each group by its documents' differences to the
    hub; ``sets`` is (doc_id, v, t). Every pair of a group that is similar
    enough is there, or both ends are paired with the hub.

    With sets of n and differences of m shingles, two documents link if they
    share c shingles of their differences, where
    2 (100 + p) c >= (100 + p) (m + m') - (100 - p) (n + n').

    In groups of up to FEW components only documents go on whose components'
    distance allows a link, and they meet those of such components. Any that meet
    by a shared shingle are told apart by their differences' parity words, too.
    """
    up, down = 100 + PERCENT, 100 - PERCENT
    hubs = sets.select(F.col("doc_id").alias("hub"), F.col("v").alias("hub_v"), F.col("t").alias("hub_t"))
    both = groups.join(hubs, "hub").join(sets, "doc_id")
    differing = F.array_union(F.array_except("t", "hub_t"), F.array_except("hub_t", "t"))
    differ = both.select("hub", "hub_v", "doc_id", "v", "component", F.size("t").alias("n"), F.size("hub_t").alias("hub_n"), differing.alias("d"))
    differ = materialize(differ.withColumns({"m": F.size("d"), "sign": _parities()}), "differences")
    near = differ.filter(up * F.col("m") <= down * (F.col("n") + F.col("hub_n"))).filter("doc_id <> hub")
    to_hub = near.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))

    group, member = ["hub", "hub_v"], ["hub", "hub_v", "doc_id", "v"]
    parts = materialize(differ.groupBy(*group).agg(F.count_distinct("component").alias("parts")), "group-parts")
    few, many = (small(parts.filter(c).select(*group)) for c in (F.col("parts") <= FEW, F.col("parts") > FEW))
    known = partners(differ.join(few, group, "left_semi"), group)
    unknown = differ.join(many, group, "left_semi").withColumns({"part": F.lit(None).cast("int"), "mask": F.lit(None).cast("long")})
    kept = differ.join(known, member).unionByName(unknown)
    tokens = materialize(kept.select(*member, "component", "part", "mask", "n", "m", "sign", F.explode("d").alias("t")), "difference-shingles")
    often = tokens.groupBy(*group, "t").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    often = materialize(often.filter("df > 1").select(*group, "t", "df", (F.col("lo") != F.col("hi")).alias("mixed")), "shared-differences")
    counted = tokens.join(often, [*group, "t"], "left").withColumns({"df": F.coalesce("df", F.lit(1)), "mixed": F.coalesce("mixed", F.lit(False))})
    place = F.row_number().over(Window.partitionBy(*member).orderBy("df", "t"))
    # A partner's set is at most 100 / p times as large.
    longest = F.floor(F.lit(down) * (100 + PERCENT) * F.col("n") / (PERCENT * up)) + 1
    prefix = counted.withColumn("i", place).filter("mixed").filter(F.col("i") <= longest)
    prefix = materialize(prefix.select(*group, "t", "doc_id", "component", "part", "mask", "n", "m", "i", "sign"), "difference-prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*group, "t")]
    able = F.expr("if(x.part is null, x.component < y.component, x.part < y.part and shiftright(x.mask, y.part) & 1 = 1 and shiftright(y.mask, x.part) & 1 = 1)")
    sizes = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    most = down * (F.col("x.n") + F.col("y.n"))
    reach = 2 * up * (1 + F.least(F.col("x.m") - F.col("x.i"), F.col("y.m") - F.col("y.i"))) >= up * (F.col("x.m") + F.col("y.m")) - most
    unlike = sum((F.bit_count(F.col("x.sign")[i].bitwiseXOR(F.col("y.sign")[i])) for i in range(SIGNS)), F.lit(0))
    met = x.join(y, same[0] & same[1] & same[2] & able & sizes & reach & (up * unlike <= most))
    pairs = met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    out = materialize(pairs.unionByName(to_hub).distinct(), "meetings")
    discard(differ, parts, known, tokens, often, prefix)
    return out


def link(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of each row, and (id, component) of each linked doc_id."""
    sketched = materialize(sketches(docs.select("doc_id", "text"), size), "sketches")
    filled = sketched.filter("n > 0 and doc_id is not null")
    # Documents of equal sets are one class, named by its smallest doc_id; rows
    # of equal doc_id are tied together by the edges between their classes.
    classes = materialize(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class"), F.count("*").alias("members")).filter("members > 1"), "set-classes")
    member = filled.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).filter("doc_id <> class")
    copies = materialize(member.select(F.col("class").alias("a"), F.col("doc_id").alias("b"), "k1", "k2").distinct(), "copies")
    heads = materialize(filled.filter("sketch is not null").join(small(copies.select(F.col("b").alias("doc_id"), "k1", "k2")), ["doc_id", "k1", "k2"], "left_anti").select("doc_id", "n", "sketch", "bands"), "class-heads")
    # Registers and bands are most of what is held: they go as soon as nothing reads them.
    keys = materialize(sketched.select("doc_id", "n", "k1", "k2"), "set-keys")
    filled = keys.filter("n > 0 and doc_id is not null")
    discard(sketched)

    banded = heads.select("doc_id", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    company = materialize(banded.join(shared, "band").select("band", F.col("doc_id").alias("b"), F.col("n").alias("nb"), "members"), "band-members")
    drawn = materialize(heads.select("doc_id", "sketch"), "class-sketches")
    discard(heads)
    known = company.join(company.groupBy("b").agg(F.sum("members").alias("company")), "b")
    hubs = known.groupBy("band").agg(F.max(F.struct("company", (-F.col("b")).alias("a"), F.col("nb").alias("na"))).alias("m")).select("band", (-F.col("m.a")).alias("a"), F.col("m.na").alias("na"))
    crowd = materialize(company.join(hubs, "band").select("band", "a", "na", "b", "nb"), "band-hubs")
    fits = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")

    def likely(pairs: DataFrame) -> DataFrame:
        of = lambda end: drawn.select(F.col("doc_id").alias(end), F.col("sketch").alias(f"s{end}"))
        valued = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", _estimated("sa", "sb"))
        return valued.filter(F.col("likeness") >= PERCENT / 100 - MARGIN).select("a", "b")

    stars = crowd.filter("a <> b").filter(fits).groupBy("a", "b").agg(F.count("*").alias("bands"))
    best = stars.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    pairs = materialize(likely(best).unionByName(copies.select("a", "b")), "pairs-1")
    sure = confirm(pairs, docs, size)
    labels = components(sure)
    # Groups that still hold several components.
    placed = crowd.select("band", F.col("a").alias("hub"), F.col("b").alias("doc_id")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "hub", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "band-components")
    mixed = materialize(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band"), "mixed-bands")
    groups = materialize(placed.join(small(mixed), "band", "left_semi").select("hub", "doc_id", "component").distinct(), "mixed-groups")
    sets = materialize(held_sets(docs, materialize(groups.select("doc_id").distinct(), "held"), size), "held-sets")
    met = materialize(likely(meetings(groups, sets)), "pairs-2")
    sure = sure.unionByName(confirm(met, docs, size))
    twice = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    tied = filled.join(twice, "doc_id").join(classes, ["n", "k1", "k2"]).filter("doc_id <> class").select(F.col("class").alias("a"), F.col("doc_id").alias("b")).distinct()
    linked = components(sure.unionByName(tied))
    discard(classes, copies, drawn, company, crowd, pairs, placed, mixed, groups, sets, met)
    return keys.select("doc_id", "n"), linked


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sizes, labels = link(docs, size)
    joined = sizes.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedupe(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs whose document is the smallest of its component."""
    _, labels = link(docs, size)
    dropped = materialize(labels.filter("id <> component").select(F.col("id").alias("doc_id")), "near-duplicates")
    return docs.join(small(dropped), "doc_id", "left_anti").select(*docs.columns)
