"""Suffix arrays and repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest

from paperweft.llm import repeats, suffixes


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = random.Random(seed)
    s = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 300))]
    if seed % 3 == 0:
        s = (s[: r.randrange(1, 12)] * 40)[:200]
    assert suffixes.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(docs, window, split, join):
    seen, out = set(), {}
    for i, text in sorted(docs):
        items = split(text or "")
        gone = set()
        for s in range(len(items) - window + 1):
            w = tuple(items[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        kept = join([x for j, x in enumerate(items) if j not in gone])
        spans = sum(j in gone and j - 1 not in gone for j in range(len(items)))
        out[i] = (len(items), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.choice([15, 25, 60]))) for _ in range(8)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages).split(" ")
            for _ in range(r.choice([0, 0, 1, 3])):
                p[r.randrange(len(p))] = word()
            parts += [" ".join(p), " ".join(word() for _ in range(r.randint(0, 30)))]
        docs.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    docs += [(200, docs[5][1]), (201, None), (202, ""), (203, "ha " * 700), (204, "x" * 3000), (205, "ab" * 60 + "c"), (206, "\x00" * 250 + "q"), (207, "\x00" * 230)]
    return docs


def rows(spark, docs, unit, *how):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int").repartition(4)
    return {r.doc_id: (r.n_items, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(df, unit, *how).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = corpus(seed)
    want = brute(docs, 20, lambda t: [w.encode() for w in t.split()], b" ".join)
    assert rows(spark, docs, repeats.Unit("word", 20, 8)) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, seed):
    docs = corpus(seed)
    want = brute(docs, 100, lambda t: [bytes([b]) for b in t.encode()], b"".join)
    assert rows(spark, docs, repeats.Unit("byte", 100, 32), suffixes.context_bytes, suffixes.judge_suffixes) == want


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(str(i) for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.remove(df, repeats.Unit("word", 20, 8)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 50), ("None", 0)]
    assert repeats.remove(df.limit(0), repeats.Unit("word", 20, 8)).count() == 0


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_hot_anchors_are_spread(spark, kind):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    some = [" ".join(word() for _ in range(30)) for _ in range(6)]
    shared = " ".join(f"shared{i}" for i in range(10))
    docs = corpus(5) + [(1000 + i, f"{word()} {r.choice(some)} {shared} {r.choice(some)} {word()}") for i in range(300)]
    how = (suffixes.context_bytes, suffixes.judge_suffixes) if kind == "byte" else (repeats.extensions, repeats.judge_extensions)
    unit, cut = (repeats.Unit("byte", 100, 32), (lambda t: [bytes([b]) for b in t.encode()], b"".join)) if kind == "byte" else (repeats.Unit("word", 20, 8), (lambda t: [w.encode() for w in t.split()], b" ".join))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_items, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove(df, unit, *how, hot=20).collect()}
    assert got == brute(docs, unit.window, *cut)
    most = lambda hot: repeats.contexts(df, repeats.occurrences(df, unit, hot), unit, how[0]).where("data is not null").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert most(20) <= 20 < most(10**9)
