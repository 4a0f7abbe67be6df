"""Repeated strings of bytes against brute force and SQL."""

import hashlib
import random

import duckdb

from tonemill.llm import oracles, repeats

DOCS = "doc_id long, text string, lang string, places string, copy int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS)


def brute(rows, n=repeats.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, d in data:
        if i is not None:
            for p in range(len(d) - n + 1):
                first[d[p : p + n]] = min(i, first.get(d[p : p + n], i))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        if i is not None:
            for p in range(len(d) - n + 1):
                if first[d[p : p + n]] < i:
                    gone[p : p + n] = [True] * n
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gämma", "дельта", "e"]) + str(rng.randrange(50)) for _ in range(n))
    shared = [words(n) for n in (9, 10, 12, 40)]
    texts = [words(rng.randrange(60)) + rng.choice(["", *shared]) + words(rng.randrange(30)) + rng.choice(["", *shared]) for _ in range(60)]
    texts += [texts[3], texts[3], "a" * 49, "a" * 50, "a" * 51, "a" * 300, "ab" * 80, "", None, shared[3] * 3]
    rng.shuffle(texts)
    return [(7 * i + 2, t) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = [*corpus(), (None, "a" * 60), (2, "a" * 60)]
    assert sorted((tuple(r) for r in repeats.report(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_equals_sql(spark):
    rows = corpus()
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    assert sorted((tuple(r) for r in repeats.report(docs(spark, rows)).collect()), key=str) == sorted(c.execute(oracles.REPEATS).fetchall(), key=str)


def test_remove_keeps_columns(spark):
    out = repeats.remove(docs(spark, [(1, "x" * 60), (2, "y " + "x" * 60), (3, None)]))
    assert out.columns == docs(spark, []).columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "x" + "x" * 59, 2: "y ", 3: None}


def test_nothing(spark):
    assert repeats.report(docs(spark, [])).count() == 0


def test_texts_of_one_id_long_texts_and_clashing_names(spark):
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(40_000))
    rows = [(9, long), (4, long[100_000:100_400]), *((7, f"{i} " + long[i * 1000 : i * 1000 + 200]) for i in range(6)), (7, long[:60]), (7, long[:60]), (8, "b" * 70), (8, "b" * 70)]
    assert sorted((tuple(r) for r in repeats.report(docs(spark, rows)).collect()), key=str) == brute(rows)
    clash = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], "doc_id long, text string, found int, digest int, id0 int, _m int, _copy int, variant int")
    out = repeats.remove(clash)
    assert out.columns == clash.columns and {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TASK_BYTES", 500)
    rows = corpus()
    assert sorted((tuple(r) for r in repeats.report(docs(spark, rows)).collect()), key=str) == brute(rows)
