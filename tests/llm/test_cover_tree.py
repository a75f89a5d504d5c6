import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import cover_tree as T

SCHEMA = "vec_id long, embedding array<float>, label int, part long, shard string, id double, vector string, low int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, "v", 2) for r in rows], SCHEMA)


def mined(spark, rows):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    cand = T.candidates(rows_of(spark, rows), F.col("vec_id"), label, F.col("embedding"))
    return sorted(map(tuple, T.hard_negatives(cand, F.col("id") % 50 == 0).collect()), key=repr)


def brute(rows):
    ok = []
    for i, v, lab in rows:
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            lab = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
            ok.append((i, lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    late = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in {r for r in ok if r[0] is not None and r[0] % 50 == 0}:
        others = [(dot(a[2], r[2]), r[0], r[1]) for r in ok if r[0] != a[0]]
        others.sort(key=lambda r: (-r[0], late(r[1])))
        for score, positive, _ in [r for r in others if r[2] == a[1]][:5]:
            found = [r for r in others if r[2] != a[1] and 50 * score <= 100 * r[0] <= 95 * score][:3]
            out += [(a[0], positive, k, n, score, s) for k, (s, n, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def corpus(n=900, dim=12, seed=3):
    """Clusters, exact copies in a group that holds a third of all rows, and vectors of very different lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 9] + rng.normal(size=dim) * (0.05 if i % 2 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v * (4 if i % 11 == 0 else 0.3)], int(rng.integers(0, 10))))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert mined(spark, rows) == brute(rows) != []


def test_many_parts_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(seed=5)
    monkeypatch.setattr(T, "PART", 60 * 12)
    monkeypatch.setattr(T, "ANCHORS", 4)
    cut = T.Index(T.candidates(rows_of(spark, rows), F.col("vec_id"), F.col("label"), F.col("embedding")))
    assert cut.parts > len(cut.centres) > 2 and cut.rows().groupBy("part").count().agg(F.max("count")).first()[0] <= 300
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, [0.5, 0.5], 1), (50, [0.9, 0.1], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (None, [1.0, 0.5], 1), (2, None, 1), (3, [nan, 1.0], 1),
            (4, [None, 1.0], 2), (5, [inf, 1.0], 2), (6, [0.4, 0.4], None), (8, [], 1), (9, [0.6], 2), (10, [0.5, 0.4, 9.0], 2), (None, [0.7, 0.3], 2), (12, [0.7, 0.3], 2), (12, [0.7, 0.3], 2),
            (100, [0.0, 0.0], 1), (150, [-1.0, -1.0], 3), (151, [-1.0, -1.0], 3), (152, [3000.0, 3000.0], 4), (200, [3000.0, 2000.0], 4)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 2), (2, [], 1)]) == brute([(0, [], 1), (1, [], 2), (2, [], 1)])


def test_tree_invariants_and_skipped_nodes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.02)).astype(np.int64)
    top = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
    tree = T.Tree(x, top)
    u = T.lifted(x[tree.order], top)
    for n, kids in enumerate(tree.children):
        centre = T.lifted(tree.centres[n:n + 1], top)[0]
        inside = u[tree.start[n]:tree.end[n]]
        assert np.arccos(np.clip(inside @ centre, -1, 1)).max() <= tree.angle[n] + 1e-6
        if kids is not None:
            assert (tree.centres[kids[0]] == tree.centres[n]).all()  # a centre is its first child's
            assert sorted((tree.start[k], tree.end[k]) for k in kids)[0][0] == tree.start[n] and sum(tree.end[k] - tree.start[k] for k in kids) == tree.end[n] - tree.start[n]
    q, ids, label = x[::400], np.arange(4000), np.zeros(4000, np.int64)
    low, high = np.full((len(q), 1), -(1 << 62)), np.full((len(q), 1), 1 << 62)
    search = T.Search(q, np.zeros(len(q), np.int64), np.full(len(q), -1), low, high, 5, True)
    scored = []
    leaf = search.leaf
    search.leaf = lambda who, rows, *rest: (scored.append(len(who) * len(rows)), leaf(who, rows, *rest))
    who, _, score, found = search.run(tree, label, ids)
    for i in range(len(q)):
        dots = x @ q[i]
        want = sorted(zip((-dots).tolist(), range(4000)))[:5]
        assert [(-s, f) for s, f in zip(score[who == i], found[who == i])] == want
    assert sum(scored) < 0.5 * len(q) * 4000


@pytest.mark.parametrize("low, high", [(0, 3), (-5, -2), (2, 1)])
def test_windows(low, high):
    x = np.arange(-50, 50)[:, None].astype(np.int64)
    search = T.Search(np.array([[1]]), np.array([0]), np.array([-1]), np.array([[low]]), np.array([[high]]), 2, False)
    _, _, score, _ = search.run(T.Tree(x, 50.0), np.ones(100, np.int64), np.arange(100))
    assert score.tolist() == sorted((v for v in range(-50, 50) if low <= v <= high), reverse=True)[:2]
