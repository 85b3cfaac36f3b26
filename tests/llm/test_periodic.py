"""Periodic runs against brute force, over tile borders, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperweft.llm import periodic, queries


def brute(w):
    """(start, length, period) by definition, by start and period."""
    runs = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and all(any(a != b for a, b in zip(stretch, stretch[d:])) for d in range(1, q)):
                runs.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rnd):
    size = rnd.choice([1, 2, 2, 3, 40])
    w = [f"w{rnd.randint(1, size)}" for _ in range(rnd.randint(0, 120))]
    for _ in range(rnd.randint(0, 3)):
        root = [f"w{rnd.randint(1, size)}" for _ in range(rnd.randint(1, 30))]
        i = rnd.randint(0, len(w))
        w[i:i] = (root * 9)[: rnd.randint(len(root), 9 * len(root))]
    return " ".join(w)


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(periodic, "TILES", 2)


def test_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = [made(rnd) for _ in range(250)] + [None, "", " \t\n", "x", "a a a a a", "a a a a a a", "a b " * 3, "A a " * 4, "é ü " * 4]
    df = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t, i, "z") for i, t in enumerate(texts)], "doc_id long, text string, row int, runs string")
    got = periodic.periodic_runs(df, give_runs=True).collect()
    want = []
    for i, t in enumerate(texts):
        runs = brute((t or "").split())
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        kept = collapsed((t or "").split(), runs)
        want.append((None if i % 50 == 7 else i // 2, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept,
                     [(s, q, n) for s, n, q in runs]))
    found = [(*r[:8], r.collapsed, [(x["start"], x["period"], x["length"]) for x in r.runs]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr) and sum(r[1] for r in want) > 300


def test_tiles_alone_give_whole_runs():
    rnd = random.Random(2)
    for _ in range(300):
        w = made(rnd).split()
        codes = np.unique(w, return_inverse=True)[1].astype(np.uint64) + np.uint64(1) if w else np.zeros(0, np.uint64)
        places = {}
        for octave in (1, 2, 4, 8, 16, 32):
            for b in periodic.screened(codes, np.array([0, len(w)]), octave).tolist() if w else []:
                for q, s, e in periodic.solve_tile(codes.tolist(), b, octave):
                    assert all(w[i] == w[i + q] for i in range(s, e))
                    places.setdefault(q, set()).update(range(s, e))
        for s, n, q in brute(w):
            assert set(range(s, s + n - q)) <= places[q]


def test_long_run_over_many_rows_of_tiles(spark, small_tiles):
    text = "start " + "x " * 4000 + "mid " + " ".join(f"r{i % 37}" for i in range(3000)) + " end"
    got = periodic.periodic_runs(spark.createDataFrame([(5, text)], "doc_id long, text string"), give_runs=True).first()
    assert [tuple(r) for r in got.runs] == [(1, 1, 4000), (4002, 37, 3000)] and got.exponent_milli == 4_000_000


def test_z_function():
    rnd = random.Random(1)
    for _ in range(200):
        x = [rnd.randint(0, 1) for _ in range(rnd.randint(0, 30))]
        assert periodic.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_query_on_a_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for r in rows:
        w = (r["text"] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) <= 1500:
            runs = brute(w)
            want[r["doc_id"]] = (len(runs), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    got = {r.doc_id: (r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in queries.QUERIES["op12_periodic_runs"](spark, path).collect()}
    assert len(got) == len(rows) and {d: got[d] for d in want} == want and any(n for n, _, _ in want.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(df).count() == 0
    assert queries.repeat_tail(pa.array([1, None], pa.int64()), pa.array([None, "a"])).to_pylist() == [None, "a"]
