import math
import random
import re
from collections import Counter

import numpy as np
from conftest import ODD

from inkstone.llm import dual_tree as T

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(TERM.findall(low))


def brute(docs, items, k=20):
    bags = [(d, b) for d, b in ((d, bag(t)) for d, t in docs) if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in {(i, t) for i, t in items if t}:
        rows = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, q in bag(text).items() if t in b)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, make, docs, items, k=20):
    found = T.rank(make(docs), spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string"), k)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=repr)


def corpus(seed=1, n=600):
    """Words of very unequal frequency; a third of all documents is one text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    text = lambda m: " ".join(words[min(199, int(rng.expovariate(0.03)))] for _ in range(m))
    same = text(40)
    docs = [(i, same if i % 3 == 0 else text(rng.randint(1, 120))) for i in range(n)]
    return docs, [(i, text(rng.randint(1, 12))) for i in range(70)] + [(70, same), (71, "none such"), (72, "w199")]


def test_equals_brute_force(spark, make):
    docs, items = corpus()
    assert ranked(spark, make, docs, items) == brute(docs, items) != []
    assert ranked(spark, make, docs, items, 3) == brute(docs, items, 3)


def test_sampled_thresholds_blocks_and_groups_change_nothing(spark, make, monkeypatch):
    docs, items = corpus(2)
    want = brute(docs, items)
    monkeypatch.setattr(T, "SAMPLE", 100)
    assert ranked(spark, make, docs, items) == want
    monkeypatch.setattr(T, "ITEM_CHARS", 700)
    monkeypatch.setattr(T, "ITEMS", 9)
    assert ranked(spark, make, docs, items) == want


def test_odd_rows(spark, make):
    odd = [*ODD, "Ünï ünï é-é A_B a", "x 1 2 3 X", "a" * 1_000_000, "word " * 200_000]
    docs = [(i, t) for i, t in enumerate(odd)] + [(None, "a b c"), (None, "a b c"), (3, "word word"), (3, "word word"), (3, "é é")]
    items = [(1, "A b"), (1, "A b"), (1, "é"), (2, None), (3, ""), (4, " \n"), (None, "word x 1"), (5, "한국 😀"), (6, "a" * 1_000_000), (7, "b " * 3000)]
    assert ranked(spark, make, docs, items) == brute(docs, items)
    assert ranked(spark, make, [], items) == ranked(spark, make, docs, []) == ranked(spark, make, [(1, None)], [(1, "a")]) == []


def test_bounds_cover_scores_and_prune():
    rng = np.random.default_rng(4)
    items = T.Items(np.arange(40), [{int(t): int(rng.integers(1, 3)) for t in rng.integers(0, 50, 6)} for _ in range(40)], rng.integers(1, 9000, 50))
    n = 3000
    doc = np.repeat(np.arange(n), 5)
    flat = np.unique(doc * 50 + rng.integers(0, 50, len(doc)))
    value = rng.integers(1, 10**6, len(flat))
    docs = T.Documents(flat // 50, flat % 50, value, np.arange(n), items)
    dense = np.zeros((n, items.width))
    dense[docs.at, docs.column] = docs.value
    for i, up in enumerate(items.levels):
        for d, top in enumerate(docs.levels):
            scores = items.weights @ dense.T
            bound = up @ top.T
            rows, cols = np.arange(len(scores)) // (T.ITEM_LEAF * T.FAN**i), np.arange(n) // (T.DOC_LEAF * T.FAN**d)
            assert (scores <= bound[rows][:, cols]).all()
    best = T.Best(40, 20)
    T.search(docs, items, best)
    item, score, ids = best.found[0]
    place = {int(x): k for k, x in enumerate(items.index)}
    for i in range(40):
        own = items.weights[place[i]] @ dense.T
        want = sorted((-int(s), int(docs.ids[j])) for j, s in enumerate(own) if s > 0)[:20]
        assert [(-int(s), int(d)) for s, d in zip(score[item == i], ids[item == i])] == want
    calls = []
    real = docs.leaf
    docs.leaf = lambda k: (calls.append(k), real(k))[1]
    T.search(docs, items, T.Best(40, 20, best.score + 10**13, best.ids))
    assert not calls  # nothing reaches such thresholds: whole batches go
