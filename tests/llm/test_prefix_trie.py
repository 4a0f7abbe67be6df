"""The trie against a plain walk over all prefixes, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tonemill.llm import oracles, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, heads=6, family=100):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        path = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()], key=str)


def made(spark, rows, parts=5, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted([tuple(r[n] for n in NAMES) for r in prefix_trie.trie(df, **how).collect()], key=str)


def some(seed, n=150, turns=7):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for i in range(rng.randrange(1, turns)):
            out.append((c * rng.choice([1, 1, 3]), i, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "éü" * 3]), "n", "d"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk_over_all_prefixes(spark, seed):
    rows = some(seed)
    assert made(spark, rows) == brute(rows)


def test_sql_equals_the_walk():
    rows = some(3)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.execute(oracles.PREFIX_TRIE).fetchall(), key=str) == brute(rows)


def test_nulls_ties_repeats_and_turnless_conversations(spark):
    rows = [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 1, "user", "z"), (7, 1, "user", "a"), (7, 1, "assistant", "z"), (-7, 1, None, None), (-107, -3, "user", "q"), (-100, 5, "user", "q"), (-100, 5, "user", "q")]
    short = next(c for c in range(500, 600) if zlib.crc32(str(c).encode()) % 6 == 5)  # its base is absent, its only turn dropped
    rows = [r + (None, None) for r in [*rows, (short, 0, "user", "gone")]]
    got = made(spark, rows)
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[2] is None and root[7] != hashlib.sha256(b"").hexdigest()


def test_long_conversations_and_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "_IDS", 8)
    rows = [(c, i, "user", f"t{i}", None, None) for c in (100, 101) for i in range(300 + c % 2)]
    rows += [(1000 + 100 * c, 0, "user", "same", None, None) for c in range(60)]
    rows.append((5, 0, "user", "x" * 200_000, None, None))
    assert made(spark, rows, 9) == brute(rows)


def test_an_empty_table_has_no_node(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
