"""The mixture of a document against expectation-maximisation written out in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from paperweft.llm import language
from paperweft.llm import words as W


def bucket(before, letter, after):
    m = (1 << 64) - 1
    h = (before * 0x9E3779B97F4A7C15 + letter * 0xD6E8FEB86659FD93 + after * 0xA0761D6478BD642F) & m
    h ^= h >> 31
    return (h * 0xBF58476D1CE4E5B9 & m) >> 48


def words_of(text):
    out, word = [], []
    for c in text + " ":
        if c.isalpha():
            low = c.lower()
            word.append(ord(low) if len(low) == 1 else ord(c))
        elif word:
            out.append([bucket(([0] + word)[i], x, (word + [0])[i + 1]) for i, x in enumerate(word)])
            word = []
    return out


def em(like, theta, rounds):
    for _ in range(rounds):
        share = [[a * t for a, t in zip(row, theta)] for row in like]
        share = [[x / max(sum(row), 1e-30) for x in row] for row in share]
        theta = [sum(col) / len(like) for col in zip(*share)]
    return theta, sum(math.log(max(sum(a * t for a, t in zip(row, theta)), 1e-30)) for row in like)


def plain(model, text):
    log = [[sum(float(model.log_p[g, j]) for g in word) for j in range(len(model.languages))] for word in words_of(text)]
    if not log:
        return "und", {}
    like = [[math.exp(x - max(row)) for x in row] for row in log]
    n = len(model.languages)
    full, _ = em(like, [1 / n] * n, language.ROUNDS)
    order = sorted(range(n), key=lambda j: -full[j])
    chosen = [float(j == order[0]) for j in range(n)]
    _, had = em(like, chosen, 0)
    for k in range(1, n):
        if full[order[k]] <= 1e-4:
            break
        begin = [max(full[j], 1e-4) if j in order[: k + 1] else 0.0 for j in range(n)]
        theta, now = em(like, [b / sum(begin) for b in begin], language.ROUNDS)
        if now - had <= language.PENALTY * math.log(len(like) + 1.0):
            break
        chosen, had = theta, now
    best = max(range(n), key=lambda j: chosen[j])
    return model.languages[best], {model.languages[j]: p for j, p in enumerate(chosen) if p > 0}


def test_mixture_equals_plain_em():
    rnd = random.Random(3)
    alphabets = {"aa": "abcdefg", "bb": "efghijkl", "cc": "lmnopqéü"}
    made = lambda name, n: " ".join("".join(rnd.choice(alphabets[name]) for _ in range(rnd.randint(1, 7))) for _ in range(n))
    counts = np.zeros((language.BUCKETS, 3))
    for j, name in enumerate(alphabets):
        for word in words_of(made(name, 400)):
            for g in word:
                counts[g, j] += 1
    model = language.Model(list(alphabets), counts)
    texts = [made("aa", 30), made("bb", 5), made("aa", 20) + " " + made("cc", 15), made("cc", 1), "12 34", "", None, "É. x", made("bb", 40) + " " + made("cc", 3), " ".join(made(x, 25) for x in alphabets)]
    got = model.predict(pa.array(texts)).to_pylist()
    for text, r in zip(texts, got):
        name, mixture = plain(model, text or "")
        have = dict(r["proportions"] or [])
        assert r["lang_pred"] == name and set(have) == set(mixture), (text, r, mixture)
        assert all(abs(have[k] - v) < 1e-3 for k, v in mixture.items()) and abs(r["score"] - max(mixture.values(), default=0)) < 1e-3
    assert len(got[2]["proportions"]) == 2 and len(got[9]["proportions"]) == 3 and W.flat(pa.array(["a"]))[1].tolist() == [0, 1]
