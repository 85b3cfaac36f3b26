"""The Jaccard join against all pairs on small inputs."""

import random

import pytest

from paperweft.llm import jaccard


def brute(docs, size, percent):
    sets = {}
    for i, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    bases = [[word() for _ in range(r.choice([1, 2, 5, 12, 40, 90, 150]))] for _ in range(6)]
    docs = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(text) + 1)
            r.choice([lambda: text.insert(at, word()), lambda: text.__delitem__(slice(at, at + 1)), lambda: text.__setitem__(slice(at, at + 1), [word()])])()
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_components_equal_all_pairs(spark, seed, size, percent):
    docs = corpus(seed, 250, 14) + [(900, None), (901, ""), (902, " \t"), (903, "One  two"), (904, "one TWO")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()}
    assert got == brute(docs, size, percent)


def test_empty_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d", 7, "x"), (1, "a b c d", 7, "x"), (None, "a b c d", 8, "y"), (2, "a b c d", 9, "z"), (3, "q " * 30_000, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, component_id string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.near_duplicates(df, 3, 90).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", 1)]
    assert jaccard.near_duplicates(df.limit(0), 3, 90).count() == 0


def test_sets_that_share_too_few_rare_elements_are_not_proposed(spark):
    """Ten sets hold 50 elements that their pivot lacks, and 30 of their own, too many to link: only the two that link are compared."""
    pivot = list(range(100))
    sets = {0: pivot, 11: pivot[:80] + list(range(9000, 9080)), 12: pivot[:80] + list(range(9000, 9079)) + [9999]}
    for i in range(1, 11):
        sets[i] = pivot[:80] + list(range(1000, 1050)) + list(range(2000 * i, 2000 * i + 30))
    profiles = spark.createDataFrame(list(sets.items()), "key long, set array<long>")
    placed = spark.createDataFrame([(i, 0, i, 0) for i in sets if i], "a long, b long, part long, pivot_part long")
    got = {(r.a, r.b) for r in jaccard._cross(placed, profiles, 80).collect()}
    assert got == {(11, 12)}
