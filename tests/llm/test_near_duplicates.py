"""Near-duplicates against brute force over all pairs."""

import os
import random
from pathlib import Path

from tonemill.llm import near_duplicates
from tonemill.llm.common import materialize, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n int, component string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS)


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[k + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 60, 150]))]
        family = [words] + [edited(rng, words, share) for share in (0.02, 0.04, 0.05, 0.06, 0.08, 0.1) for _ in range(4)]
        rows += [" ".join(f) for f in family]
    rows += ["", None, "one", "one", "ONE", "a b", "und und und und und", "und und und", "  x \t y \n z ", "x y z", "a  b"]
    rng.shuffle(rows)
    return [(3 * i + 5, t) for i, t in enumerate(rows)] + [(5, "another text of the same id"), (None, "no id"), (None, None)]


def test_equals_brute_force(spark):
    rows = corpus()
    for size in (2, 5):
        got = sorted((tuple(r) for r in near_duplicates.near_duplicates(docs(spark, rows), size).collect()), key=str)
        assert got == brute(rows, size)


def test_dedupe_keeps_one_of_each(spark):
    rows = [(i, t) for i, t in corpus(2) if i is not None and i != 5]
    out = near_duplicates.dedupe(docs(spark, rows), 5)
    assert out.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _, _, kept in brute(rows, 5) if kept)


def test_nothing(spark):
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicates.dedupe(docs(spark, [(1, None)])).count() == 1


def reaches(pairs):
    """The smallest id that each one reaches."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_meetings_lose_no_link(spark):
    """Every pair of a group that is similar enough meets, or both meet the
    hub, though each row stands three times and some ids also have another
    text; what meets is far less than all pairs."""
    rng = random.Random(3)
    rows = []
    for family in range(8):
        words = [f"f{family}w{i}" for i in range(60)]
        for k in range(12):
            own = list(words)
            for i in rng.sample(range(60), rng.choice([1, 3, 5, 7, 9])):
                own[i] = f"e{family}x{k}x{i}" if k % 3 else f"e{family}x{i}"
            rows.append((100 * family + k, " ".join(own)))
        rows.append((100 * family, " ".join(f"o{family}w{i}" for i in range(40))))
    ids = sorted({i for i, _ in rows})
    # Each family around its third document, and all documents around one more.
    groups = spark.createDataFrame([(i // 100 * 100 + 2, i, i) for i in ids] + [(5, i, i) for i in ids], "hub long, doc_id long, component long")
    sets = near_duplicates.held_sets(docs(spark, rows * 3), groups.select("doc_id").distinct(), 1)
    got = {tuple(r) for r in near_duplicates.meetings(groups, sets).collect()}
    held = [(i, shingles(t, 1)) for i, t in rows]
    want = {(a, b) for a, s in held for b, t in held if a < b and 100 * len(s & t) >= 80 * len(s | t)}
    reach = reaches(got)
    assert len(want) > 50 and all(reach[a] == reach[b] for a, b in want)
    assert len(got) < 0.2 * len(ids) ** 2 / 2


def test_sketches_of_a_batch_are_those_of_each_text():
    rng = random.Random(5)
    texts = [t.encode() if t is not None else None for _, t in corpus(5)] + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)).encode()]
    probes = near_duplicates._probes()
    for size in (1, 2, 5):
        hashes = near_duplicates.WordHashes()
        flat, n = near_duplicates.shingle_sets(texts, size, hashes)
        each = [near_duplicates.shingle_set(t.decode() if t is not None else None, size, hashes) for t in texts]
        assert n.tolist() == [len(s) for s in each] and flat.tolist() == [h for s in each for h in s.tolist()]
        together = near_duplicates.registers(flat, n[n > 0], probes)
        for s, got in zip([s for s in each if len(s)], together, strict=True):
            least = {}
            for h in s.tolist():
                least.setdefault(h >> 56, h & (1 << 56) - 1)
            for bucket, register in enumerate(got.tolist()):
                rest = least[next(b for b in probes[bucket] if b in least)] if bucket not in least else least[bucket]
                bits = rest.bit_length()
                assert register == (56 - bits) << 10 | (rest >> max(bits - 11, 0)) & 1023


def test_families_around_the_threshold(spark):
    """Edits of a text that isn't there, mostly just under or over the
    threshold to each other, with and without a common source."""
    rng = random.Random(11)
    rows = []
    for family in range(6):
        words = [f"v{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(25):
            own = list(words)
            for i in rng.sample(range(120), rng.choice([2, 3, 4, 5, 6, 7])):
                own[i] = f"v{rng.randrange(3000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
        if family % 2:
            rows.append((2000 + family, " ".join(words)))
    got = sorted((tuple(r) for r in near_duplicates.near_duplicates(docs(spark, rows), 2).collect()), key=str)
    assert got == brute(rows, 2)


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    near = words[:-500] + [f"n{i}" for i in range(500)]
    far = words[:20_000] + [f"n{i}" for i in range(10_000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (4, None)]
    clash = spark.createDataFrame([(i, t, i, i, i) for i, t in rows], "doc_id long, text string, n long, component long, band long")
    out = near_duplicates.dedupe(clash, 5)
    assert out.columns == clash.columns
    assert sorted((r["doc_id"], r["n"]) for r in out.collect()) == [(1, 1), (3, 3), (4, 4), (4, 4)]


def test_equals_brute_force_with_each_row_twice(spark):
    rows = corpus(4) * 2
    got = sorted((tuple(r) for r in near_duplicates.near_duplicates(docs(spark, rows), 2).collect()), key=str)
    assert got == brute(rows, 2)


def test_families_of_one_template_meet_in_proportion(spark):
    """Sub-families of a template whose members edit the same spots: what meets
    grows no faster than the rows."""
    import random

    from pyspark.sql import functions as F

    from tonemill.llm import near_duplicates as nd

    rng = random.Random(11)
    template = [f"w{i}" for i in range(300)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    subs = [edited(template, 18) for _ in range(4)]
    texts = [" ".join(edited(subs[i % 4], 6)) for i in range(800)]
    seen = []
    for n in (200, 800):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "doc_id long, text string")
        met = []
        plain = nd.meetings

        def counted(groups, sets, met=met, plain=plain):
            out = plain(groups, sets)
            met.append(out.filter("a <> b").join(groups.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), ["a", "b"], "left_anti").count())
            return out

        nd.meetings = counted
        try:
            got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, size=2).collect()}
        finally:
            nd.meetings = plain
        seen += met
        hashes = nd.WordHashes()
        held = [set(nd.shingle_set(t, 2, hashes).tolist()) for t in texts[:n]]
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                both = len(held[i] & held[j])
                if 100 * both >= 80 * (len(held[i]) + len(held[j]) - both):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        assert [got[i] for i in range(n)] == label
    # 168 and 739 when written; by the square it would be sixteen times as many.
    assert seen[1] <= 6 * max(seen[0], 50)


def test_registers_are_held_once(spark, monkeypatch):
    """Registers go where nothing reads them any more: never twice beside what
    else a step holds, and bands not behind the step that reads them."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before, held = set(os.listdir(folder)), {}

    def watched(df, name):
        out = materialize(df, name)
        held.setdefault(name, {f.rpartition("-")[0] for f in set(os.listdir(folder)) - before if "." not in f})
        return out

    monkeypatch.setattr(near_duplicates, "materialize", watched)
    words = [f"w{i}" for i in range(60)]
    texts = [(k, " ".join(words[: 50 + k])) for k in range(6)] + [(6, " ".join(words[:50])), (7, None)]
    got = near_duplicates.near_duplicates(docs(spark, texts), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: 0 for k in range(7)} | {7: 7}
    assert "class-heads" in held["band-members"] and "sketches" not in held["band-members"]
    assert "class-sketches" in held["confirmed"] and not held["confirmed"] & {"sketches", "class-heads"}
