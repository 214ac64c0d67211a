"""op6 scores with two previous words, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pulseloom.llm import lm, queries
from tests.conftest import SF


def brute(texts, order):
    words = [(t or "").encode().lower().split() for t in texts]
    grams = lambda d, n: Counter(tuple(d[k : k + n]) for k in range(len(d) - n + 1))
    counts = {n: Counter(g for d in words for g in grams(d, n).elements()) for n in range(1, order + 1)}
    total, out = sum(map(len, words)), []
    for d in words:
        own = {n: grams(d, n) for n in range(1, order + 1)}
        rest, s = total - len(d), 0.0
        c = lambda g: counts[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        for k in range(len(d)):
            p = min(1, c((d[k],)) / rest) if c((d[k],)) else 1 / (rest + 1)
            for n in range(2, min(order, k + 1) + 1):
                g = tuple(d[k - n + 1 : k + 1])
                p = min(1, c(g) / max(1, c(g[:-1]))) if c(g) else lm.ALPHA * p
            s += math.log10(p)
        out.append((len(d), s))
    return out


def test_query_is_of_order_three(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_words, r.log10_score) for r in queries.op6_lm(spark, SF).collect()}
    for r, (n, s) in zip(docs, brute([r.text for r in docs], 3), strict=True):
        assert got[r.doc_id][0] == n and got[r.doc_id][1] == pytest.approx(s, abs=1e-4)


def test_packing():
    r = random.Random(6)
    for keys in ([0], [2**64 - 1], [5, 2**64 - 1], range(300), [0, *range(2**63, 2**63 + 9)], {r.getrandbits(64) for _ in range(5000)}):
        x = np.array(sorted(keys), np.uint64)
        assert lm.unpacked(lm.packed(x)).tolist() == x.tolist()
    x = np.array([0, 1, 254, 255, 256, 2**40])
    for usual in (0, 1, 7):
        assert lm.unpacked_counts(lm.packed_counts(x, usual), 6, usual).tolist() == x.tolist()
    many = np.unique(np.array([r.getrandbits(64) for _ in range(100000)], np.uint64))
    assert len(lm.packed(many)) < 0.85 * 8 * len(many)
